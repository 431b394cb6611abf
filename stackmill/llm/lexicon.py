"""A vocabulary as a trie, intersected with automata of the ways in which a scanned word may have been misread: first with
that of known misreadings, then with the Levenshtein automaton of the word, which lets through every word within one or
two edits."""

from __future__ import annotations

from bisect import bisect_left

# What is read on scanned pages, and what was printed there.
MISREADINGS = {
    "1": ["l", "i"], "|": ["l", "i"], "0": ["o"], "5": ["s"], "9": ["g"], "8": ["b"], "6": ["b"], "@": ["a"], "é": ["e"], "í": ["i"], "á": ["a"], "ó": ["o"], "ú": ["u"], "c": ["e"], "f": ["t"], "t": ["f"],
    "ri": ["n"], "n": ["ri"], "l": ["i"], "ſ": ["s"], "b": ["h"], "h": ["b"], "cl": ["d"], "d": ["cl"], "ii": ["u"], "rn": ["m"], "m": ["rn"], "vv": ["w"], "ﬁ": ["fi"], "ﬂ": ["fl"], "li": ["h"], "!": ["l", "i"], "$": ["s"], "e": ["c"], "q": ["g"],
}
HIGHEST = "\U0010ffff"


class Lexicon:
    """Words with their counts. The trie is the sorted list itself: a node is the range of words with its prefix.

    `pairs` are known pairs of neighbouring words, and `often` words that recur in scans, so that they are no single misreadings.
    """

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int] | None = None, often: frozenset[str] = frozenset()) -> None:
        self.counts, self.words, self.pairs, self.often = counts, sorted(counts), pairs or {}, often
        self.known: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
        self.near: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
        self.nodes: dict[tuple[int, int, int], list[tuple[str, int, int]]] = {}

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    def _child(self, prefix: str, lo: int, hi: int) -> tuple[int, int]:
        lo = bisect_left(self.words, prefix, lo, hi)
        return lo, bisect_left(self.words, prefix + HIGHEST, lo, hi)

    def readings(self, word: str, most: int = 3) -> list[tuple[int, int, str]]:
        """(edits, minus count, word) of every word of which `word` may be a misreading in at most `most` places, best first."""
        if (word, most) in self.known:
            return self.known[word, most]
        found: dict[str, int] = {}
        stack = [(0, "", 0, len(self.words), 0)]
        while stack:
            i, prefix, lo, hi, edits = stack.pop()
            if i == len(word):
                if lo < hi and self.words[lo] == prefix and edits:
                    found[prefix] = min(found.get(prefix, 99), edits)
                continue
            steps = [(1, word[i], 0)]
            if edits < most:
                steps += [(n, meant, 1) for n in (1, 2) for meant in MISREADINGS.get(word[i : i + n], ()) if len(word[i : i + n]) == n]
            for n, meant, cost in steps:
                a, b = self._child(prefix + meant, lo, hi)
                if a < b:
                    stack.append((i + n, prefix + meant, a, b, edits + cost))
        self.known[word, most] = got = sorted((e, -self.counts[w], w) for w, e in found.items())
        return got

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[str, int, int]]:
        """The letters that follow a prefix of `depth` letters, each with the range of words that go on with it."""
        if (lo, hi, depth) not in self.nodes:
            out, at = [], lo + (len(self.words[lo]) == depth)
            while at < hi:
                end = bisect_left(self.words, self.words[at][: depth + 1] + HIGHEST, at, hi)
                out.append((self.words[at][depth], at, end))
                at = end
            self.nodes[lo, hi, depth] = out
        return self.nodes[lo, hi, depth]

    def nearest(self, word: str, most: int = 1) -> list[tuple[int, int, str]]:
        """(edits, minus count, word) of every word within `most` edits, at least one: a letter more, less or another one,
        or two letters for one of MISREADINGS.

        The automaton is run with a bitmap for each number of edits, whose bit i says that i letters of `word` are read.
        """
        if (word, most) in self.near:
            return self.near[word, most]
        end, inside = 1 << len(word), (2 << len(word)) - 1
        same: dict[str, int] = {}
        merged: dict[str, int] = {}
        for i, c in enumerate(word):
            same[c] = same.get(c, 0) | 1 << i
            for meant in MISREADINGS.get(word[i : i + 2], ()) if i + 1 < len(word) else ():
                if len(meant) == 1:
                    merged[meant] = merged.get(meant, 0) | 1 << i
        start = [1]
        for _ in range(most):
            start.append((start[-1] | start[-1] << 1) & inside)
        found: dict[str, int] = {}
        stack = [(0, len(self.words), 0, start)] if self.words else []
        while stack:
            lo, hi, depth, read = stack.pop()
            if len(self.words[lo]) == depth:
                edits = next((e for e, bits in enumerate(read) if bits & end), 0)
                if edits:
                    found[self.words[lo]] = edits
            for c, a, b in self.children(lo, hi, depth):
                at, two = same.get(c, 0), merged.get(c, 0)
                now = [(read[0] & at) << 1]
                for e in range(1, most + 1):
                    now.append(((read[e] & at) << 1 | read[e - 1] | read[e - 1] << 1 | now[e - 1] << 1 | (read[e - 1] & two) << 2) & inside)
                if any(now):
                    stack.append((a, b, depth + 1, now))
        self.near[word, most] = got = sorted((e, -self.counts[w], w) for w, e in found.items())
        return got

    def fitting(self, options: list[tuple[int, int, str]], before: str, after: str) -> list[tuple[int, int, str]]:
        """The readings that stand beside both neighbours in known pairs; none where there is no neighbour."""
        return [o for o in options if (before or after) and (not before or (before, o[2]) in self.pairs) and (not after or (o[2], after) in self.pairs)]

    def best(self, options: list[tuple[int, int, str]], before: str, after: str) -> str:
        """Of the readings with the fewest edits, the one that best fits the words before and after it, then the most frequent."""
        first = [o for o in options if o[0] == options[0][0]]
        return min(first, key=lambda o: (-self.pairs.get((before, o[2]), 0) - self.pairs.get((o[2], after), 0), o[1], o[2]))[2]
