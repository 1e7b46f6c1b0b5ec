"""Operator 2: secret scans with inferred grammars.

Base patterns give labelled credentials. For each kind the prefix tree of a bounded sample of them, over character
classes, is merged: two states become one where a Hoeffding test finds their endings and successors compatible
(ALERGIA) and a test of their remaining lengths does too, so that a format of fixed length keeps it. A candidate's score is the log-likelihood ratio, in bits a character, of the best kind's automaton against
a model of ordinary tokens, learned from candidates that are plainly words, paths, dates and the like; candidates over a
limit, set between those and held-out credentials, are added to the base spans.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST = 12  # characters of a candidate, as of the shortest credential that a base pattern takes
_SIGNS = "+/_.=-"
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
# A token that is no secret to the eye: between its signs stand words, with a short number or none, and numbers.
_PLAIN = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[+/_.=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*")
# Classes of characters and their sizes: the letters of hex digits, other lower case, upper case, digits, signs.
_CLASS = {c: k for k, cs in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.=-")) for c in cs}
_SIZE = (6, 20, 26, 10, 6)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted: leftmost non-overlapping for each kind, those that are long
    enough. Of access and hex, a match that is too short has no longer one inside, so their length is in the pattern."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What runs of credential characters leave outside the base spans, signs at the ends stripped, of LEAST characters and
    more."""
    out, spans, i = [], sorted((a, b) for a, _, b in taken), 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while i < len(spans) and spans[i][1] <= at:
            i += 1
        parts, j = [], i
        while j < len(spans) and spans[j][0] < end:
            parts.append((at, spans[j][0]))
            at = max(at, spans[j][1])
            j += 1
        for start, stop in (*parts, (at, end)):
            if stop - start >= LEAST:
                run = text[start:stop]
                start += len(run) - len(run.lstrip(_SIGNS))
                stop = start + len(run.strip(_SIGNS))
                if stop - start >= LEAST:
                    out.append((start, stop))
    return out


@dataclass
class Automaton:
    """A probabilistic automaton over character classes: for each state its ends, visits and moves (class: (next, n)), and the
    sums of its visits' remaining lengths and of their squares."""

    moves: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    rest: list[int] = field(default_factory=lambda: [0])
    rest2: list[int] = field(default_factory=lambda: [0])

    def visit(self, s: int, left: int) -> None:
        self.visits[s] += 1
        self.rest[s] += left
        self.rest2[s] += left * left

    def add(self, word: str) -> None:
        s, left = 0, len(word)
        self.visit(0, left)
        for c in word:
            move = self.moves[s].get(k := _CLASS[c])
            if move is None:
                move = self.moves[s][k] = [len(self.moves), 0]
                self.moves.append({})
                for column in (self.visits, self.ends, self.rest, self.rest2):
                    column.append(0)
            move[1] += 1
            s, left = move[0], left - 1
            self.visit(s, left)
        self.ends[s] += 1

    def alike_in_length(self, a: int, b: int) -> bool:
        """Whether the mean remaining lengths are within three standard errors of each other."""
        n, m = self.visits[a], self.visits[b]
        x, y = self.rest[a] / n, self.rest[b] / m
        spread = max(self.rest2[a] / n - x * x, self.rest2[b] / m - y * y, 0.0)
        return abs(x - y) <= 3 * math.sqrt(spread * (1 / n + 1 / m)) + 1e-9

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        if not self.alike_in_length(a, b):
            return False
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for k in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(k), self.moves[b].get(k)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for column in (self.visits, self.ends, self.rest, self.rest2):
                column[a] += column[b]
            for k, (s, n) in self.moves[b].items():
                if k in self.moves[a]:
                    self.moves[a][k][1] += n
                    todo.append((self.moves[a][k][0], s))
                else:
                    self.moves[a][k] = [s, n]

    def merge(self, alpha: float = 0.05) -> Automaton:
        """Settles states in the order of their finding: each joins the first settled state that it is compatible with."""
        red, settled = [0], {0}
        while (found := next(((r, k, m[0]) for r in red for k, m in sorted(self.moves[r].items()) if m[0] not in settled), None)) is not None:
            r, k, s = found
            q = next((q for q in red if self.compatible(q, s, alpha)), None)
            if q is None:
                red.append(s)
                settled.add(s)
            else:
                self.moves[r][k][0] = q
                self.fold(q, s)
        return self

    def bits(self, word: str) -> float:
        """log2 of the word's likelihood, each class's characters being alike. A move never seen counts a tenth of a visit and
        leads where most go from there, so that the rest is still told by its place."""
        s, out = 0, 0.0
        for c in word:
            k, moves = _CLASS[c], self.moves[s]
            to, n = moves[k] if k in moves else (max(moves.values(), key=lambda m: m[1])[0] if moves else s, 0)
            out += math.log2((n + 0.1) / (self.visits[s] + 0.6) / _SIZE[k])
            s = to
        return out + math.log2((self.ends[s] + 0.1) / (self.visits[s] + 0.6))


def folded(word: str) -> str:
    """Words in upper case alone as in lower case: 0AF and 0af are one format."""
    return word.lower() if word == word.upper() else word


@dataclass
class Scanner:
    """Automata of the labelled kinds, the automaton of ordinary tokens, and the limit between them."""

    kinds: list[Automaton]
    ordinary: Automaton
    limit: float = math.inf

    def score(self, word: str) -> float:
        word = folded(word)
        return max((a.bits(word) for a in self.kinds), default=-math.inf) / len(word) - self.ordinary.bits(word) / len(word)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        if self.limit == math.inf:
            return base
        return sorted(base + [(a, 3, b) for a, b in candidates(text, base) if self.score(text[a:b]) > self.limit])


def infer(credentials: dict[str, list[str]], ordinary: list[str], margin: float = 0.1) -> Scanner:
    """The ordinary model is made of the plain tokens of ordinary alone, so unlabelled secrets among them neither teach it
    nor lift the limit. The limit lies halfway from the plain tokens' upper thousandth to the lowest twentieth of
    credentials held out of their automata, margin bits over that thousandth and over 0 at least; without credentials or
    plain tokens nothing is added to the base."""
    trees, halves, held = [], [], []
    for _, values in sorted(credentials.items()):
        values = sorted(set(values))
        trees.append(_tree(values).merge())
        halves.append(_tree(values[::2]).merge())
        held += values[1::2] or values
    # Ordinary tokens come in few formats; a looser test keeps their automaton small.
    tokens = sorted(v for v in set(ordinary) if _PLAIN.fullmatch(v))
    scanner = Scanner(trees, _tree(tokens).merge(0.01))
    if held and tokens:
        own = sorted(map(Scanner(halves, scanner.ordinary).score, held))
        rest = sorted(map(scanner.score, tokens))
        high = rest[(len(rest) * 999 - 1) // 1000]
        scanner.limit = max(margin, high + margin, (high + own[len(own) // 20]) / 2)
    return scanner


def _tree(values: list[str]) -> Automaton:
    tree = Automaton()
    for v in values:
        tree.add(folded(v))
    return tree


def learn(docs: DataFrame, texts: int = 20_000, values: int = 400, longest: int = 4096, characters: int = 100_000) -> Scanner:
    """Infers from a bounded sample: about texts texts, chosen by a hash of the text; of a kind values values (of ordinary
    tokens five times as many), whole, none over longest and all together not over characters long. Scanning knows no such
    bounds."""
    share = min(1.0, texts / max(1, docs.count()))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                rows = set()
                for t in part.column("text").to_pylist():
                    base = base_spans(t)
                    for a, k, b in base:
                        rows.add((KINDS[k], _ASSIGN.match(t, a).group(2) if k == 0 else t[a:b]))
                    rows.update(("", t[a:b]) for a, b in candidates(t, base))
                rows = [(k, v) for k, v in rows if len(v) <= longest]
                yield pa.RecordBatch.from_pylist([{"kind": k, "value": v} for k, v in rows], schema=pa.schema([("kind", pa.string()), ("value", pa.string())]))

    found = docs.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).select("text").mapInArrow(run, "kind string, value string").distinct()
    # One pass over the texts: each kind's values of the smallest hashes, ranked.
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    few = found.withColumn("r", rank).filter(F.col("r") <= F.when(F.col("kind") == "", 5 * values).otherwise(values))
    by: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in few.select("kind", "value").collect():
        left[r.kind] = left.get(r.kind, characters) - len(r.value)
        if left[r.kind] >= 0:
            by.setdefault(r.kind, []).append(r.value)
    return infer({k: v for k, v in by.items() if k}, by.get("", []))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """docs with found, array<struct<kind, start, end>>: base spans and those added, by start, then kind. Positions are
    code points, ends exclusive. Null and empty texts have none; very long ones are scanned whole; a score of exactly the
    limit adds nothing; repeated rows have equal spans; an empty table gives no rows; a column of docs called found is
    replaced, others of any name stay."""
    docs = docs.drop("found").withColumn("text", F.col("text").cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in held.value.spans(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, "found"])

    return docs.mapInArrow(run, docs.withColumn("found", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema)
