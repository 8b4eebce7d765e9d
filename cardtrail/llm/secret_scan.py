"""Secret scans: base patterns plus guess-cost segmentation of credential values.

Three base patterns give spans of kind ``assign``, ``access`` and ``hex``. Beside them,
every value that stands in a credential context (``pwd: ...``, ``client_secret=...``) is
priced by the cheapest way to guess it: a dynamic programme over the value's positions
splits it into dictionary words, dates, repeats, keyboard walks, sequences and
brute-force characters, adding the log10 guesses of the parts. A value that a quote
opens ends at the closing quote, whatever its length; any other ends at white space, a single quote, markup,
or a field separator (``, ; & |``) that a name and ``=`` or ``:`` follow. A value that
costs at least ``min_guesses`` (log10) becomes a span of kind ``guess`` unless it lies
wholly in a base span. Base spans are never removed; redaction takes the union of spans.

Null texts count as empty; a text without secrets has zero counts, an empty ``spans``
and the digest of the empty string. Every row gives one result row (repeated rows
repeat); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from cardtrail.llm.common import map_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Credential contexts whose values are priced; group 1 is the quote that opens the value.
CONTEXT = re.compile(
    r"""(?ai:(?:pass(?:wd|word|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|"""
    r"""access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?key|bearer))["']?\x20*[:=]\x20*(["']?)""")
#: A quoted value on one line: backslashes escape, no word goes on behind the closing quote.
QUOTED = {q: re.compile(rf"((?:[^{q}\\\r\n]++|\\[^\r\n])*+){q}(?![^\W_])") for q in "\"'"}
#: Where a value without quotes ends: at the next field, at markup, or at a character that no value has.
END = re.compile(r"""[,;&|][\[{]{0,2}["']?[A-Za-z_][\w.-]*["']?[:=]|"/?>|</?[A-Za-z][^<>]*>|[^!-&(-~]|\Z""", re.A)

#: Common password words, most used first (fixed values); cost is log10 of twice the rank.
WORDS = {w: math.log10(2 * (i + 1)) for i, w in enumerate((
    "password the and you that love admin welcome letmein monkey dragon master login qwerty sunshine princess "
    "football baseball shadow superman batman trustno hello freedom whatever secret summer winter spring autumn "
    "hunter killer soccer hockey george michael jordan harley ranger thomas robert daniel andrew joshua jessica "
    "ashley nicole amanda charlie computer internet google server system test user guest root default public "
    "private token key access change example sample demo data house time life home work money happy flower orange "
    "purple yellow green black white silver gold star moon night day pass word account january february march april "
    "may june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday").split())}
LONGEST_WORD = max(map(len, WORDS))
#: Rows of a keyboard, left to right (fixed values).
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT_KEYS = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])} | {b + a for row in KEY_ROWS for a, b in zip(row, row[1:])}
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301$57", "aaeoissT".lower())
DAY_COST = math.log10(366 * 120)


def _brute(ch: str) -> float:
    """log10 of the size of the character's class."""
    if ch.isdigit():
        return 1.0
    if ch.isascii() and ch.isalpha():
        return math.log10(26)
    return math.log10(33) if ch.isascii() else 3.0


class Runs:
    """The least best[i] + base + log10(end - i) over the starts i, at least three before
    the end, of a run (a repeat, a walk or a sequence) that goes on to the end.

    Of two starts the later gains less with every further end, so once an earlier start
    is the cheaper one it stays so. The stack holds the starts that are cheapest at some
    end, the present one on top, each with the end from which the one below is cheaper."""

    def __init__(self, lengths: list[int], base: float):
        self.lengths, self.base = lengths, base
        self.stop, self.stack = -1, []

    def cost(self, end: int, best: list[float]) -> float:
        start = end - 3
        if start >= 0 and self.lengths[start] >= 3:
            if start + self.lengths[start] != self.stop:
                self.stop, self.stack = start + self.lengths[start], []
        elif end > self.stop:
            return math.inf
        stack = self.stack
        while stack and stack[-1][2] <= end:
            stack.pop()
        if start + self.lengths[start] == self.stop:
            self._add(start, best[start], end)
        i, cost, _ = stack[-1]
        return cost + self.base + math.log10(end - i)

    def _add(self, start: int, cost: float, end: int) -> None:
        turn = math.inf
        while self.stack:
            i, before, below = self.stack[-1]
            if before + math.log10(end - i) <= cost + math.log10(end - start):
                return
            more = cost - before  # the earlier start is cheaper once (end - i) / (end - start) <= 10^more
            ratio = 10 ** min(more, 300)
            turn = (ratio * start - i) / (ratio - 1) if ratio > 1 else math.inf
            if turn < below:
                break
            self.stack.pop()  # the one below it is cheaper before it has its turn
            turn = math.inf
        self.stack.append((start, cost, turn))


def guess_cost(value: str) -> float:
    """Least log10 number of guesses over all segmentations of ``value`` (0 if empty)."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    # the length of the repeat, the keyboard walk and the sequence that start at i
    repeat, walk, run = [1] * (n + 1), [1] * (n + 1), [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        step = ord(value[i + 1]) - ord(value[i])
        if step == 0:
            repeat[i] = repeat[i + 1] + 1
        if low[i:i + 2] in NEXT_KEYS:
            walk[i] = walk[i + 1] + 1
        if abs(step) == 1 and value[i].isalnum() and value[i + 1].isalnum():
            run[i] = run[i + 1] + 1 if i + 2 < n and ord(value[i + 2]) - ord(value[i + 1]) == step else 2
    runs = Runs(repeat, 1.5), Runs(walk, 2.3), Runs(run, 1.7)
    for i in range(n + 1):
        best[i] = at = min(best[i], *(r.cost(i, best) for r in runs)) if i else 0.0
        if i == n:
            break
        best[i + 1] = min(best[i + 1], at + _brute(value[i]))
        for size in range(3, min(LONGEST_WORD, n - i) + 1):
            for text, extra in ((low, 0.0), (plain, 0.3)):
                cost = WORDS.get(text[i:i + size])
                if cost is not None:
                    upper = 0.0 if value[i:i + size] == low[i:i + size] else 0.3 + 0.1 * sum(c.isupper() for c in value[i:i + size])
                    best[i + size] = min(best[i + size], at + cost + extra + upper)
        if value[i].isdigit():
            m = DATE.match(value, i)
            if m:
                best[m.end()] = min(best[m.end()], at + (DAY_COST if m.end() - i > 4 else 2.1))
    return best[n]


def _value_end(text: str, start: int, quote: str) -> tuple[int, int]:
    """The end of the value at ``start``, and where the search for the next one goes on."""
    if quote:
        m = QUOTED[quote].match(text, start)
        if m:
            return m.end(1), m.end()
    end = last = END.search(text, start).start()
    while end > start and text[end - 1] in "\"'.,;:)]}>":
        end -= 1
    return end, last


def find_spans(text: str, min_guesses: float = 10.0) -> list[tuple[int, int, int, int, int]]:
    """(start, kind index, end, value start, value end) of all spans, by start and kind."""
    spans = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _, _ in spans)
    starts, furthest = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    m = CONTEXT.search(text)
    while m:
        start = m.end()
        end, after = _value_end(text, start, m[1])
        before = bisect_right(starts, start)
        within = before and end <= furthest[before - 1]
        if end - start >= 6 and not within and guess_cost(text[start:end]) >= min_guesses:
            spans.append((start, 3, end, start, end))
        m = CONTEXT.search(text, max(start, after))
    return sorted(spans)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _, _ in spans)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, min_guesses: float = 10.0) -> DataFrame:
    """Per row: doc_id, counts per base kind, sha256 of the base spans, all spans."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                spans = find_spans(text, min_guesses) if text else []
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return map_batches(docs.select("doc_id", "text"), run, SCAN_SCHEMA)


def redact(text: str, min_guesses: float = 10.0, mark: str = "[REDACTED]") -> str:
    """``text`` with the value of every span replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((vs, ve) for _, _, _, vs, ve in find_spans(text, min_guesses)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, min_guesses: float = 10.0, mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns, secret values in ``text`` replaced; ``n_chars``, if
    there, follows the text. Null texts stay null."""

    def run(batches):
        for pdf in batches:
            pdf["text"] = [redact(t, min_guesses, mark) if t else t for t in pdf["text"]]
            if "n_chars" in pdf:
                pdf["n_chars"] = [len(t) if t is not None else n for t, n in zip(pdf["text"], pdf["n_chars"])]
            yield pdf

    return map_batches(docs, run, docs.schema)
