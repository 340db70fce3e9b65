"""Secret scan with password guess-cost dynamic programming.

Base kinds are plain patterns. The method takes the values that stand in a credential context (a key word, a
separator, a value) and computes the fewest guesses that spell each: the cheapest segmentation into common words,
dates, repeats, keyboard walks, character sequences and brute-force spans, over every span of the value. Words are the
common pass words below and, less common than those, the whole words of a public tokenizer's vocabulary in its order.
Values that cost at least `min_log10` guesses become spans of the kind "guess"; placeholders and dictionary words stay.

Costs are exact below `min_log10`, and beyond it only known to be: segments that cost as much are left out. Repeats and
walks have spans of any length; of the places that one may begin at only those are kept that some end can still prefer.

A cheap automaton over the whole column picks the rows that hold any candidate; only these are scanned.
Defined cases: null text is empty and has no span; an empty table gives no rows; a null doc_id is a document like others;
texts are scanned whole, a very long one in one piece; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import small_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|bearer)["']?[ \t]*(?:=>|:=|[:=])[ \t]*["']?([^\s"'`,;<>(){}]{6,})""",
    re.I | re.A,
)
ANY = r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private)[_-]?key|credential|bearer)|AKIA[A-Z0-9]|[0-9a-f]{24}"

# Common pass words, by rank.
WORDS = """password qwerty abc123 iloveyou admin welcome monkey login letmein dragon master hello freedom whatever
trustno1 sunshine princess football baseball shadow michael superman batman secret test root user guest default
changeme example sample dummy placeholder your here insert token value none null true false xxx todo key api
pass word the and for you love summer winter spring autumn company office server database""".split()

# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_LEET = str.maketrans("013457@$", "oleasta" "s")
_YEAR, _MONTH, _DAY, _MARK = r"(?:19|20)[0-9][0-9]", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"[-/._]?"
#: Years, and days either way round, with log10 of their guesses.
DATES = (
    (re.compile(_YEAR), math.log10(120)), (re.compile(_YEAR + _MARK + _MONTH + _MARK + _DAY), math.log10(120 * 365 * 4)), (re.compile(_DAY + _MARK + _MONTH + _MARK + _YEAR), math.log10(120 * 365 * 4)),
)
#: log10 of the kinds that a segment may be of.
SEGMENT = math.log10(5)
#: log10 of the guesses that each further character of a walk adds: whether it turns.
TURN = 0.15


@lru_cache(maxsize=4)
def ranks(path: str | None = None) -> dict[str, int]:
    """Words by how early they are guessed. path: a tiktoken vocabulary, the public byte-level BPE by default."""
    import public_tokenizers

    out = {w: k + 1 for k, w in enumerate(WORDS)}
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            word = token[1:].lower()
            if token[:1] == b" " and len(word) >= 4 and word.isalpha() and word.isascii():  # bytes: ASCII letters
                out.setdefault(word.decode(), len(out) + 1)
    return out


def _brute(text: str) -> float:
    """log10 of the guesses for one character at a time, by the classes that occur."""
    size = 10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text)
    return math.log10(max(10, size + 33 * any(not c.isalnum() for c in text)))


def near_keys(a: str, b: str) -> bool:
    return a in _KEY and b in _KEY and a != b and abs(_KEY[a][0] - _KEY[b][0]) <= 1 and abs(_KEY[a][1] - _KEY[b][1]) <= 1


def next_character(a: str, b: str) -> bool:
    return abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


#: Walks: what follows what, and log10 of the guesses for the first character.
WALKS = ((near_keys, math.log10(47)), (next_character, math.log10(36)))


def word_cost(word: str, rank: dict[str, int]) -> float | None:
    """log10 of the guesses for a word, with capitals or other characters for letters."""
    low = word.lower()
    plain = low.translate(_LEET)
    found = rank.get(low) or rank.get(plain)
    return math.log10(found * (1 + (word != low)) * (1 + (low not in rank))) + SEGMENT if found else None


@dataclass
class Run:
    """A stretch whose spans of `least` characters or more, in multiples of `unit`, are one segment each. A span costs
    `base`, `slope` for each character and log10 of its units."""

    start: int
    end: int
    unit: int
    least: int
    base: float
    slope: float
    open: dict[int, list[tuple[int, float]]] = field(default_factory=dict)

    def best(self, j: int, best: list[float]) -> float:
        """The cheapest way to j by a span that ends there."""
        a, u = j - self.least, self.unit
        kept = self.open.setdefault(j % u, [])
        # A later start is of use only if no kept one is cheaper already where the later one may first end.
        mine = best[a] - self.slope * a
        if all(mine < g + math.log10((a - b + self.least) / self.least) for b, g in kept):
            kept.append((a, mine))
        return min(g + self.slope * j + math.log10((j - b) / u) for b, g in kept) + self.base


def _runs(text: str, step: float, most: float) -> list[Run]:
    """Stretches of repeats and of walks."""
    n, low, out = len(text), text.lower(), []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for u in range(1, min(n // 2, int(min(most / step, n))) + 1):
        same = np.concatenate(([False], code[u:] == code[:-u], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # text[a : b + u] has the period u
            unit = text[a : a + u]
            if b - a >= u and unit not in (unit + unit)[1:-1]:  # a unit that repeats itself is never the cheapest
                out.append(Run(a, b + u, u, 2 * u, u * step + SEGMENT, 0.0))
    for near, first in WALKS:
        s = 0
        for k in range(1, n + 1):
            if k == n or not near(low[k - 1], low[k]):
                if k - s >= 3:
                    out.append(Run(s, k, 1, 3, first + SEGMENT, TURN))
                s = k
    return sorted(out, key=lambda r: r.start + r.least)


def guess_cost(value: str, most: float = math.inf, rank: dict[str, int] | None = None) -> float:
    """log10 of the fewest guesses that spell the value, over all segmentations; exact below `most`, and where it is
    `most` or more some number that is too."""
    n, rank = len(value), ranks() if rank is None else rank
    if not n:
        return 0.0
    step, runs, live, at = _brute(value), _runs(value, _brute(value), most), [], 0
    longest = max(map(len, rank), default=0)
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in DATES:
        for a in range(n - 3):
            if m := pattern.match(value, a):
                dates.setdefault(m.end(), []).append((a, cost + SEGMENT))
    # best[j]: the least cost of value[:j]; brute: the least of those that end in a brute-force span.
    best, brute = [0.0] + [math.inf] * n, math.inf
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + SEGMENT) + step
        cost = brute
        for a in range(max(0, j - longest), j - 2):
            if best[a] < cost and (own := word_cost(value[a:j], rank)) is not None:
                cost = min(cost, best[a] + own)
        for a, own in dates.get(j, ()):
            cost = min(cost, best[a] + own)
        while at < len(runs) and runs[at].start + runs[at].least <= j:
            live.append(runs[at])
            at += 1
        live = [r for r in live if r.end >= j]
        best[j] = min([cost, *(r.best(j, best) for r in live)])
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def spans(text: str, min_log10: float) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    out = base_spans(text)
    for m in CONTEXT.finditer(text):
        if guess_cost(m.group(1), min_log10) >= min_log10:
            out.append(("guess", m.start(1), m.end(1)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(min_log10: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            hit = np.flatnonzero(pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False))
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for k, text in zip(hit.tolist(), texts.take(pa.array(hit)).to_pylist(), strict=True):
                found[k] = [{"kind": a, "start": s, "end": e} for a, s, e in spans(text, min_log10)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, min_log10: float = 10.0) -> DataFrame:
    """(doc_id, spans) of every row; positions are code points, ends exclusive."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan(min_log10), "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )
