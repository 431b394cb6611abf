"""zstandard dictionaries written from counts, so that the counting may be spread over tasks and take in a whole corpus.

zstandard's own training needs all of its samples in one process. A dictionary (RFC 8878, section 5) is a Huffman code
for the bytes that match nothing, three codes for matches, and a content to match; here the first is made from a count
of bytes, the content is given, and the codes for matches are fixed.
"""

from __future__ import annotations

from heapq import merge

MAGIC, DICT_ID = 0xEC30A437, 1 << 15
#: Longest code of a byte, and the bits of the table that codes the lengths of these codes.
MOST_BITS, WEIGHT_LOG = 11, 6
# Fixed values, of RFC 8878: how often each code for a match's length and for a run of unmatched bytes comes, out of 64.
MATCH_LENGTHS = [1, 4, 3, 2, 2, 2, 2, 2, 2] + [1] * 37 + [-1] * 7
RUN_LENGTHS = [4, 3] + [2] * 11 + [1] * 3 + [2] * 9 + [3, 2] + [1] * 5 + [-1] * 4
#: The same for the power of two of a distance: even from 2^6 to 2^14, where the words of a dictionary stand by falling value.
DISTANCES = [1] * 6 + [6] * 9 + [1] * 4


def code_lengths(counts: list[int], most: int = MOST_BITS) -> list[int]:
    """Bits of each symbol in the best prefix code of at most `most` bits (package-merge); every symbol gets a code."""
    leaves = sorted((max(1, n), (s,)) for s, n in enumerate(counts))
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        row = [*merge(leaves, packages)]
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
    bits = [0] * len(counts)
    for _, symbols in packages[: len(counts) - 1]:
        for s in symbols:
            bits[s] += 1
    return bits


def _shares(counts: list[int], log: int) -> list[int]:
    """Counts as shares of 2^log, at least one for each symbol that occurs."""
    total, size = sum(counts), 1 << log
    out = [max(1, n * size // total) if n else 0 for n in counts]
    while (rest := size - sum(out)) != 0:
        change = 1 if rest > 0 else -1
        s = max((s for s, n in enumerate(out) if n and n + change), key=lambda s: change * (counts[s] / total * size - out[s]))
        out[s] += change
    return out


def _table(shares: list[int], log: int) -> bytes:
    """The description of a table of finite state entropy (section 4.1.1); -1 is a share below one."""
    bits, at = log - 5, 4
    remaining, threshold, width = (1 << log) + 1, 1 << log, log + 1
    s = 0
    while s < len(shares) and remaining > 1:
        share = shares[s]
        s += 1
        most = 2 * threshold - 1 - remaining
        remaining -= abs(share)
        value = share + 1 + (most if share + 1 >= threshold else 0)
        bits |= value << at
        at += width - (value < most)
        while remaining < threshold:
            width, threshold = width - 1, threshold >> 1
        if share == 0:
            start = s
            while shares[s] == 0:
                s += 1
            zeros = s - start
            for _ in range(zeros // 3):
                bits |= 3 << at
                at += 2
            bits |= zeros % 3 << at
            at += 2
    return bits.to_bytes((at + 7) // 8, "little")


def _coded(symbols: list[int], shares: list[int], log: int) -> bytes:
    """Symbols in finite state entropy with two states in turn, from the last one to the first."""
    size, step = 1 << log, (5 << log >> 3) + 3
    at, place = [0] * size, 0
    for s, n in enumerate(shares):
        for _ in range(n):
            at[place] = s
            place = (place + step) & (size - 1)
    states: list[list[int]] = [[] for _ in shares]
    for i, s in enumerate(at):
        states[s].append(size + i)

    stream, length = 0, 0
    now: dict[int, int] = {}
    for i in range(len(symbols) - 1, -1, -1):
        s, turn = symbols[i], i % 2
        n = shares[s]
        if turn not in now:
            now[turn] = states[s][0]  # any state of the symbol may be the last one
            continue
        width = 0
        while now[turn] >> width >= 2 * n:
            width += 1
        stream |= (now[turn] & ((1 << width) - 1)) << length
        length += width
        now[turn] = states[s][(now[turn] >> width) - n]
    for turn in (1, 0):
        stream |= (now[turn] - size) << length
        length += log
    stream |= 1 << length
    return stream.to_bytes(length // 8 + 1, "little")


def dictionary(content: bytes, byte_counts: list[int]) -> bytes:
    """A dictionary of `content` (8 bytes or more) and of a code for unmatched bytes that come as often as counted."""
    bits = code_lengths(byte_counts)
    if len({*bits}) == 1:  # equal lengths have no description of their own
        bits[0x20], bits[0xFE], bits[0xFF] = bits[0] - 1, bits[0] + 1, bits[0] + 1
    longest = max(bits)
    weights = [longest + 1 - b for b in bits[:-1]]  # that of the last byte follows from the others
    shares = _shares([weights.count(w) for w in range(max(weights) + 1)], WEIGHT_LOG)
    coded = _table(shares, WEIGHT_LOG) + _coded(weights, shares, WEIGHT_LOG)
    huffman = bytes([len(coded)]) + coded
    head = MAGIC.to_bytes(4, "little") + DICT_ID.to_bytes(4, "little")
    matches = _table(DISTANCES, 6) + _table(MATCH_LENGTHS, 6) + _table(RUN_LENGTHS, 6)
    return head + huffman + matches + b"".join(n.to_bytes(4, "little") for n in (1, 4, 8)) + content
