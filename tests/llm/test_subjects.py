from collections import Counter

import numpy as np

from stackmill.llm.subjects import Spread, assign
from stackmill.llm.words import language

TERMS = {s: [f"{s[:3]}{a}{b}" for a in ("bar", "lon", "mir", "tov", "sul", "den", "gar", "pel") for b in ("ing", "mest", "ora", "utt", "isk", "and", "elp", "oft", "urn", "agg")] for s in ("sea", "kitchen", "forest")}
GENERAL = [f"{a}{b}" for a in ("re", "con", "pre", "sub", "inter", "trans", "ob", "dis", "per", "ex", "ad", "pro") for b in ("solve", "tend", "ject", "mit", "spect", "form", "port", "duce", "tract", "serve")]


def text(rng, *subjects, n=60):
    words = []
    for i in range(n):
        pool = TERMS[subjects[i * len(subjects) // n]] if subjects and rng.random() < 0.6 else GENERAL
        words += ["the", pool[rng.integers(len(pool))], "of", "and"]
    return " ".join(words) + "."


def test_held_out_documents(spark):
    rng = np.random.default_rng(2)
    names = list(TERMS)
    rows, true = [], {}
    for i in range(600):
        kind = () if i % 10 == 9 else (names[i % 3],) if i % 10 < 7 else (names[i % 3], names[(i + 1) % 3])
        rows.append((i, text(rng, *kind), "s"))
        true[i] = set(kind)
    rows += [(900, None, "s"), (901, "", "s"), (0, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, s, "a1") for i in range(120) for s in (true[i] or {"none"})] + [(3, None, "a1"), (5000, "sea", "a2")], "doc_id bigint, subject string, annotator string")
    subjects = spark.createDataFrame([(s, s, f"texts about {', '.join(w[:3])}.") for s, w in TERMS.items()], "subject string, label string, description string")
    got = {}
    for r in assign(docs, subjects, labels, topics=8, iterations=25).collect():
        assert r["subject"] not in got.setdefault(r["doc_id"], set())
        got[r["doc_id"]].add(r["subject"])
    held = [i for i in range(120, 600)]
    hit = sum(len(true[i] & got.get(i, set())) for i in held)
    assert hit / sum(len(got.get(i, ())) for i in held) >= 0.85 and hit / sum(len(true[i]) for i in held) >= 0.85
    assert 900 not in got and 901 not in got
    assert assign(docs.limit(0), subjects, labels).count() == 0


def test_ten_documents_of_one_language(spark):
    rng = np.random.default_rng(5)
    names = list(TERMS)
    german = {s: [f"{w}ung" for w in ws[:40]] for s, ws in TERMS.items()}
    rows = [(i, text(rng, names[i % 3]), names[i % 3]) for i in range(150)]
    for i in range(10):
        pool = german[names[i % 3]]
        rows.append((200 + i, " ".join(f"die {pool[rng.integers(40)]} von und nicht" for _ in range(60)) + ".", names[i % 3]))
    rows.append((300, "1 2 3", "none"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, s) for i, _, s in rows if i < 60 or 200 <= i < 206], "doc_id bigint, subject string")
    subjects = spark.createDataFrame([(s, f"texts about {', '.join(w[:3])}.") for s, w in TERMS.items()], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in assign(docs.drop("subject"), subjects, labels, topics=8, iterations=25).collect()}
    assert {(i, s) for i, _, s in rows if 206 <= i < 300} <= got and not {d for d, _ in got} & {300}
    assert len([1 for d, _ in got if 200 <= d < 210]) <= 12
    one = docs.where("doc_id in (200, 300)").drop("subject")
    assert {(r["doc_id"], r["subject"]) for r in assign(one, subjects, labels, topics=8, iterations=5).collect()} == {(200, names[0])}
    assert assign(docs.where("doc_id = 300"), subjects, labels).count() == 0


def test_language_by_common_words():
    assert language(Counter("the la the".split())) == "en" and language(Counter("la de".split())) == "es" and language(Counter("zzz".split())) is None


def test_frequent_terms_of_one_subject_are_kept():
    spread = Spread(["hull", "thing"], {"hull": {"sea": 9.0}, "thing": {"sea": 3.0, "none": 3.0, "law": 3.0}}, {"sea": 10.0, "law": 10.0, "none": 10.0}, {"sea": "", "law": ""})
    assert spread.spoken[0].max() == 1.0 and spread.spoken[1].max() < 0.4
