"""Secret scans: formats of credentials learned by grammar inference.

Labelled credentials of one format make a prefix tree over character classes and literal separators.
States whose outgoing frequencies are statistically compatible (Hoeffding bound, recursively) are merged
into a probabilistic automaton (ALERGIA).  In every long run of credential characters the automata start
wherever they accept the four characters of a mark; a substring that ends
before a separator or with the run is scored by its log-likelihood a character over that of a background
model of ordinary text.  Above ``min_score`` a character it may be a secret; of those that overlap, the ones that
exceed it most, together, are taken, in one pass over the run.
Fixed patterns for assignments, access keys and hexadecimal runs find their spans besides.

The labelled rows are bounded: ``max_labelled`` a format are used, chosen by hash; the automata are small
and travel with the tasks.  Everything that is scanned is scanned whole.

Defined results: a null or empty text has no spans; overlapping spans of different kinds all stay; a
repeated row is scanned again; an empty table gives an empty result; columns of the input named like a
result column are replaced.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded_batches

SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Kinds of the fixed patterns, in their order; learned kinds follow by name.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")  # the runs of 16 and more among the longest runs [0-9a-f]+
MIN_LENGTH, SEPARATORS, MARK = 16, "+/_.=-", 4
_CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)


@dataclass(frozen=True)
class GrammarParams:
    #: Confidence of the Hoeffding test: smaller merges more.
    alpha: float = 0.05
    max_labelled: int = 400
    #: Nats a character above the background.
    min_score: float = 0.35
    #: Probability that stands for a transition never seen.
    floor: float = 1e-4


def symbol(c: str) -> str:
    """Separators stand for themselves; letters and digits for their class."""
    return "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "F" else "G" if "G" <= c <= "Z" else "0" if c.isdigit() else c


_SYMBOLS = {ord(c): symbol(c) for c in string.ascii_letters + string.digits}


class Automaton:
    """A probabilistic deterministic automaton inferred by state merging."""

    def __init__(self, samples: list[list[str]], alpha: float):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in samples:
            q = 0
            for c in s:
                self.count[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                q = self.next[q][c]
            self.count[q][""] += 1
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """The Hoeffding test on all outgoing frequencies, then on the states they lead to."""
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            n, m = sum(self.count[p].values()), sum(self.count[q].values())
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p][c] / n - self.count[q][c] / m) > limit:
                    return True
                if c in self.next[p] and c in self.next[q]:
                    pairs.append((self.next[p][c], self.next[q][c]))
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            self.count[p].update(self.count[q])
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    pairs.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t

    def _merge(self, bound: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in red:
                if not self._differ(r, q, bound):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red]
        keep = {q: i for i, q in enumerate(red)}
        self.next = [{c: keep[t] for c, t in self.next[q].items()} for q in red]
        self.count = [self.count[q] for q in red]

    def table(self) -> list[dict[str, tuple[int, float]]]:
        """For each state: symbol -> (next state, log probability); the empty symbol ends."""
        out = []
        for q, counts in enumerate(self.count):
            n = sum(counts.values())
            out.append({c: (self.next[q].get(c, q), math.log(k / n)) for c, k in counts.items()})
        return out


@dataclass(frozen=True)
class Grammars:
    """Transition tables by format, and log probabilities of symbol pairs in ordinary text."""

    tables: dict
    background: dict
    params: GrammarParams
    #: Length of the longest labelled credential of each format.
    longest: dict

    def score(self, text: str) -> tuple[str, float]:
        """The likeliest format and its log-likelihood a character over the background's."""
        floor, best = math.log(self.params.floor), ("", -math.inf)
        syms = [symbol(c) for c in text]
        path = [*_path(text), ""]
        ordinary = sum(self.background.get(p, floor) for p in zip(["", *syms], [*syms, ""]))
        for name, table in self.tables.items():
            q, total = 0, 0.0
            for c in path:
                q, p = table[q].get(c, (q, floor))
                total += p
            if total > best[1]:
                best = (name, total)
        return best[0], (best[1] - ordinary) / (len(text) + 1)

    @cached_property
    def _alphabets(self) -> dict[str, set[str]]:
        """Symbols that each format holds behind its mark."""
        return {name: {c for state in table for c in state if len(c) == 1} for name, table in self.tables.items()}

    @cached_property
    def _states(self) -> tuple[list[dict], list[str], list[int]]:
        """The states of all automata, numbered through, with the format of each and the numbers of the first ones."""
        states, owner, firsts = [], [], []
        for name, table in self.tables.items():
            firsts.append(len(states))
            states += [{c: (firsts[-1] + q, p) for c, (q, p) in state.items()} for state in table]
            owner += [name] * len(table)
        return states, owner, firsts

    def find(self, run: str) -> list[tuple[str, int, int]]:
        """(format, start, end) of the credentials in a run of their characters: those apart from each other that exceed the least score most, together.

        One pass from left to right.  ``live`` holds a start for each state and length (lengths of
        ``MIN_LENGTH`` and more are one): all that follows counts the same for two starts in one state, so the
        better one stands for both, and a character costs no more than the automata have states.
        """
        floor, least = math.log(self.params.floor), self.params.min_score
        syms, size = run.translate(_SYMBOLS), len(run)
        background, (states, owner, firsts) = self.background, self._states
        marks = {c[1] for q in firsts for c in states[q] if len(c) == 2}
        best, taken, live, before = [0.0] * (size + 1), {}, {}, ""
        for i, (char, sym) in enumerate(zip(run, syms)):
            ordinary = background.get((before, sym), floor)
            before = sym
            moved, last = {}, i + 1 == size or run[i + 1] in SEPARATORS
            for (q, n), (value, total, at) in live.items():
                seen = states[q].get(sym if n >= MARK else "=" + char)
                if seen:
                    q, p = seen
                elif n < MARK:
                    continue
                else:
                    p = floor
                total += p - ordinary
                # Two symbols unheard of, and nothing to make up for them.
                if total < 2 * floor:
                    continue
                value += p - ordinary - least
                to = (q, n + 1 if n < MIN_LENGTH else n)
                if to not in moved or value > moved[to][0]:
                    moved[to] = value, total, at
            if char in marks and i + MIN_LENGTH <= size:
                first = background.get(("", sym), floor)
                for q in firsts:
                    seen = states[q].get("=" + char)
                    if seen:
                        gain = seen[1] - first
                        moved[seen[0], 1] = best[i] + gain - least, gain, i
            live, best[i + 1] = moved, best[i]
            if last and live:
                done = background.get((sym, ""), floor) + least
                for (q, n), (value, _, at) in live.items():
                    if n == MIN_LENGTH and value - done + states[q].get("", (q, floor))[1] > best[i + 1]:
                        best[i + 1], taken[i + 1] = value - done + states[q].get("", (q, floor))[1], (owner[q], at)
        out, end = [], size
        while end:
            if end in taken:
                out.append((*taken[end], end))
            end = taken[end][1] if end in taken else end - 1
        out.reverse()
        return [(name, at, self._tail(name, run, syms, at, end, nxt)) for (name, at, end), nxt in zip(out, [*(x[1] for x in out[1:]), size])]

    def _tail(self, name: str, run: str, syms: str, at: int, end: int, stop: int) -> int:
        """The end of a credential found up to ``end``: a separator that the format can hold does not end it
        while it is no longer than the longest labelled one, so that no tail may stay in the text."""
        alphabet, stop, far = self._alphabets[name], min(stop, at + self.longest.get(name, 0)), end
        while far < stop and syms[far] in alphabet:
            far += 1
            if far == len(run) or run[far] in SEPARATORS:
                end = far
        return end


def _path(text: str) -> list[str]:
    """Symbols of a credential; its first four characters, where formats have their mark, stand for themselves."""
    return [("=" + c) if i < MARK else symbol(c) for i, c in enumerate(text)]


_ALNUM, _URL, _DIGITS, _HEXES = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-", string.digits, "0123456789abcdef"
#: Publicly documented credential formats: marks, then the alphabets of the parts with their lengths; a lone string stands for itself. Fixed values.
FORMATS = {
    "github": ("ghp_ gho_ ghs_", (_ALNUM, (36,))),
    "gitlab": ("glpat-", (_URL, (20,))),
    "google": ("AIza", (_URL, (35,))),
    "slack": ("xoxb- xoxp-", (_DIGITS, (10, 11, 12, 13)), "-", (_DIGITS, (10, 11, 12, 13)), "-", (_ALNUM, (24, 32))),
    "stripe": ("sk_live_ rk_live_ sk_test_ rk_test_", (_ALNUM, (24, 32))),
    "npm": ("npm_", (_ALNUM, (36,))),
    "jwt": ("eyJhb eyJ0e", (_URL, (15, 31, 60)), ".eyJ", (_URL, (30, 60, 120)), ".", (_URL, (43,))),
    "access": ("AKIA ASIA", (string.ascii_uppercase + "234567", (16,))),
}


def ordinary_text(rng: random.Random) -> str:
    """A string of credential characters that is none: names, paths, numbers, digests, identifiers, dates."""
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 5)))
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    kind = rng.random()
    if kind < 0.10:
        return some(_HEXES, rng.choice([32, 40, 64]))
    if kind < 0.16:
        return "-".join(some(_HEXES, n) for n in (8, 4, 4, 4, 12))
    if kind < 0.20:
        return some(_DIGITS, rng.randint(16, 30))
    if kind < 0.25:
        return rng.choice("_-").join(word().upper() for _ in range(rng.randint(2, 5)))
    if kind < 0.30:
        return "".join(word().title() for _ in range(rng.randint(3, 6)))
    if kind < 0.34:
        return f"20{some(_DIGITS, 2)}-{some(_DIGITS, 2)}-{some(_DIGITS, 2)}T{some(_DIGITS, 2)}.{some(_DIGITS, 6)}Z"
    parts = [rng.choice([word(), word().title(), str(rng.randint(0, 99999)), word() + str(rng.randint(0, 99))]) for _ in range(rng.randint(2, 5))]
    return rng.choice("/_.-=").join(parts)


def labelled_credentials(seed: int = 7, each: int = 200) -> list[tuple[str, str]]:
    """(format, credential) rows made from the public formats, and (``""``, string) rows of ordinary text."""
    rng, out = random.Random(seed), []
    for name, (marks, *parts) in FORMATS.items():
        for _ in range(each):
            out.append((name, rng.choice(marks.split()) + "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.choice(p[1]))) for p in parts)))
    # Ordinary runs end in a separator now and then, as a sentence does.
    return out + [("", ordinary_text(rng) + (rng.choice(SEPARATORS) if rng.random() < 0.2 else "")) for _ in range(20 * each)]


def learn_grammars(labelled: list[tuple[str, str]] | DataFrame | None = None, params: GrammarParams = GrammarParams()) -> Grammars:
    """Automata of all formats in ``labelled`` (format, text); the format ``""`` labels ordinary text."""
    if labelled is None:
        labelled = labelled_credentials()
    elif isinstance(labelled, DataFrame):
        from pyspark.sql import Window as W

        first = W.partitionBy("format").orderBy(F.xxhash64("text"), "text")
        some = labelled.select("format", "text").filter("format is not null and text is not null").withColumn("_n", F.row_number().over(first))
        labelled = [(r["format"], r["text"]) for r in some.filter(F.col("_n") <= params.max_labelled).collect()]
    samples = defaultdict(list)
    for name, text in labelled:
        samples[name].append(text)
    pairs = Counter(p for t in samples.pop("", []) for p in zip(["", *map(symbol, t)], [*map(symbol, t), ""]))
    starts = Counter()
    for (a, _), n in pairs.items():
        starts[a] += n
    background = {p: math.log(n / starts[p[0]]) for p, n in pairs.items()}
    return Grammars({k: Automaton([_path(t) for t in v[: params.max_labelled]], params.alpha).table() for k, v in sorted(samples.items())}, background, params, {k: max(map(len, v)) for k, v in samples.items()})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def find_spans(text: str | None, grammars: Grammars) -> list[tuple[str, int, int]]:
    """All spans by start, then kind: the fixed kinds as listed, then learned ones by name."""
    if not isinstance(text, str) or not text:
        return []
    out = base_spans(text)
    for m in _CANDIDATE.finditer(text):
        out += [(f"format_{name}", m.start() + a, m.start() + z) for name, a, z in grammars.find(m[0])]
    order = {k: i for i, k in enumerate(BASE_KINDS)}
    return sorted(out, key=lambda x: (x[1], order.get(x[0], len(order)), x[0], x[2]))


def scan_secrets(docs: DataFrame, grammars: Grammars | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``."""
    grammars = grammars or learn_grammars()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": z} for k, a, z in find_spans(t, grammars)] for t in texts], dtype=object)

    return docs.withColumn("spans", spans(F.col(text_col)))


def redact(text: str | None, grammars: Grammars, mark: str = "<secret>") -> str | None:
    """``text`` with every span, and what overlaps it, replaced by one mark."""
    if not isinstance(text, str):
        return None
    out, at = [], 0
    for _, a, z in sorted(find_spans(text, grammars), key=lambda x: x[1]):
        if z > at:
            if a >= at:
                out += [text[at:a], mark]
            at = z
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, grammars: Grammars | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text, and the length column brought up to date."""
    grammars = grammars or learn_grammars()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, grammars) for t in texts], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
