"""Every registered query of the subpackage on the smallest tables, against brute force, an exact round trip or labels."""

import re
from collections import defaultdict

import numpy as np
import pytest

from stackmill.llm import queries
from stackmill.llm.leaks import words_of
from stackmill.llm.packing import token_counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").distinct().collect()]


def test_nearest_points_against_brute_force(run, rows):
    parts = defaultdict(dict)
    for r in rows("points"):
        v = np.array(r["vector"] if r["vector"] is not None and None not in r["vector"] else [], dtype="f4").astype("f8")
        if len(v) == 64 and v.any():
            parts[r["collection"]][r["point_id"]] = v / np.linalg.norm(v)
    want = set()
    for of in parts.values():
        ids, v = list(of), np.array(list(of.values()))
        s = v @ v.T
        np.fill_diagonal(s, -1)
        for i, a in enumerate(ids):
            want |= {tuple(sorted((a, ids[j]))) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    got = {(r["point_lo"], r["point_hi"]) for r in run("p2_found")}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_pieces_restore_their_texts(run, rows):
    by = defaultdict(list)
    for r in run("p5_pieces"):
        by[r["case_id"]].append((r["piece_no"], r["start"], r["text"]))
    for c in rows("rcts_cases"):
        body = (c["text"] or "").strip()
        if not body:
            assert c["case_id"] not in by
            continue
        end = 0
        for n, (no, start, text) in enumerate(sorted(by[c["case_id"]])):
            assert no == n and start <= end and body[start : start + len(text)] == text and (not c["chunk_size"] or c["chunk_size"] < 1 or len(text) <= c["chunk_size"])
            end = start + len(text)
        assert end == len(body)


def test_oversized_cases_against_their_definition(run, rows):
    want = set()
    for c in rows("rcts_cases"):
        body, size = (c["text"] or "").strip(), c["chunk_size"] or 0
        if size >= 1 and len(body) > size:
            for kind, parts in (("paragraph", re.split(r"\n(?:[^\S\n]*\n)+", body)), ("line", body.split("\n")), ("word", body.split()), ("char", [])):
                if all(len(p.strip()) <= size for p in parts):
                    want.add((c["case_id"], kind))
                    break
    assert {(r["case_id"], r["finest"]) for r in run("p5_found")} == want


def test_containers_hold_every_token_once(spark, run, rows):
    tokens = {r["doc_id"]: r["tokens"] for r in token_counts(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    capacity = {r["profile"]: r["capacity"] for r in rows("pack_limits")}
    filled, whole = defaultdict(int), defaultdict(list)
    for r in run("p6_packed"):
        filled[r["profile"], r["container"]] += r["tokens"]
        whole[r["profile"], r["doc_id"]].append((r["piece"], r["first_token"], r["tokens"]))
    assert all(n <= capacity[p] for (p, _), n in filled.items())
    for p in capacity:
        assert {d for q, d in whole if q == p} == {d for d, n in tokens.items() if n}
        assert sum(tokens.values()) >= 0.9 * capacity[p] * len({c for q, c in filled if q == p}) or capacity[p] > 2000
    for (p, d), pieces in whole.items():
        assert sum(n for _, _, n in pieces) == tokens[d] and (len(pieces) == 1 or tokens[d] > capacity[p])


def test_leaks_hold_the_words_of_their_items(run, rows):
    docs = {r["doc_id"]: [w for w, _, _ in words_of(r["text"] or "")] for r in rows("documents")}
    items = {r["item_id"]: [[w for w, _, _ in words_of(r[f] or "")] for f in ("q", "passage")] for r in rows("eval_items")}
    got = {(r["doc_id"], r["item_id"]) for r in run("p7_found")}
    for n, exact in ((15, True), (7, False)):  # every exact run of 15 words is a leak, and every leak has one of 7
        runs = defaultdict(set)
        for item, fields in items.items():
            for ws in fields:
                for i in range(len(ws) - n + 1):
                    runs[tuple(ws[i : i + n])].add(item)
        seen = {(d, item) for d, ws in docs.items() for i in range(len(ws) - n + 1) for item in runs.get(tuple(ws[i : i + n]), ())}
        assert seen <= got if exact else got <= seen
    spans = defaultdict(list)
    for r in run("p7_removal_spans"):
        spans[r["doc_id"]].append((r["first"], r["last"]))
    assert set(spans) == {d for d, _ in got} and all(a[1] < b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))


def test_subjects_agree_with_the_labels(run, rows):
    labels = defaultdict(set)
    for r in rows("subject_labels"):
        if r["subject"]:
            labels[r["doc_id"]].add(r["subject"])
    found = defaultdict(set)
    for r in run("p8_found"):
        found[r["doc_id"]].add(r["subject"])
    hit = sum(len(found[d] & s) for d, s in labels.items())
    assert hit >= 0.7 * sum(len(s - {"none"}) for s in labels.values()) and hit >= 0.7 * sum(len(found[d]) for d in labels)


def test_records_that_are_no_prose_have_reasons(run):
    told = {(r["tab"], r["rec_id"]): r for r in run("p1_statistics")}
    got = {(r["tab"], r["rec_id"]) for r in run("p1_found")}
    assert got == {k for k, r in told.items() if r["not_prose"]} and all("not_prose" in told[k]["reasons"] for k in got) and all(told[k]["not_prose_share"] > 0.5 for k in got)


def test_noise_stands_in_scanned_lines(run, rows):
    spans = {r["span_id"]: r for r in rows("text_spans")}
    found = run("p3_found")
    assert found and len(found) == len({tuple(r) for r in found})
    for r in found:
        line = spans[r["span_id"]]["text"].split("\n")[r["line_no"]]
        assert line.strip() and (r["noise"] != "hyphen" or re.search(r"[-‐¬­]\s*$", line)) and (r["noise"] != "letterspace" or re.search(r"\b\w\s{1,3}\w\b", line))
    assert {r["source_id"] for r in run("p3_paragraphs")} >= {spans[r["span_id"]]["source_id"] for r in found if r["noise"] in ("hyphen", "ocr")}


def test_restored_spans_are_those_found(run, rows):
    restored = {r["span_id"]: r for r in run("p4_restored")}
    assert set(restored) == {r["span_id"] for r in run("p4_found")}
    texts = {r["span_id"]: r["text"] for r in rows("text_spans")}
    assert all(not texts[i].isascii() and (r["restored"] != texts[i] or r["lost"]) for i, r in restored.items())
