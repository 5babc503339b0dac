"""URL rules as one bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical URL ``.host/path``. All globs are laid side
by side in one row of bits, packed in 64-bit words, and a character moves every state of
every glob at once: D = ((D << 1) & B[c]) | (D & S[c]), the shift carrying across words.
A batch of URLs is simulated together; a URL leaves as soon as only settled states live.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte other than ``/``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``tier`` 0 decides before 1; within a tier the longest name wins, then block over allow."""

    name: str
    verdict: str
    glob: str
    tier: int = 0


def host_rule(name: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, where the path starts so. A host alone fits every path."""
    host, slash, path = name.partition("/")
    escaped = "".join(f"\\{c}" if c in "*?\\" else c for c in f".{host}{slash}{path}")
    return Rule(name, verdict, f"*{escaped}**" if slash else f"*{escaped}")


# The rules asked for.
RULES = (
    host_rule("com/en/", "block"),
    host_rule("example.com/en/7", "allow"),
    host_rule("net/de/", "allow"),
    host_rule("example.net/de/8", "block"),
    host_rule("org/es/", "block"),
)
# Where none of those fits: link farms by the labels of their hosts, and shop or tracker paths.
GLOBS = tuple(Rule(g, "block", g, 1) for g in ("*.cheap-*.**", "*.spam-*.**", "*.free-bets.**", "*.ads-*.**", "*.*casino*.**", "**/wp-login.php", "**/cart/**"))
DEFAULT = "allow"


def _tokens(glob: str) -> list[tuple[str, int]]:
    """('byte', value), ('one', 0), ('run', 0) for *, ('any', 0) for **; a backslash takes the next character as it is."""
    out: list[tuple[str, int]] = []
    data, at = glob.encode(), 0
    while at < len(data):
        if data[at] == 0x5C and at + 1 < len(data):
            out.append(("byte", data[at + 1]))
            at += 2
        elif data[at : at + 2] == b"**":
            out.append(("any", 0))
            at += 2
        else:
            out.append({0x2A: ("run", 0), 0x3F: ("one", 0)}.get(data[at], ("byte", data[at])))
            at += 1
    return out


class Automaton:
    """The packed masks of a list of rules.

    A glob of m single-byte tokens has m + 1 states. State k lives after k tokens; a gap
    (* or **) between tokens lets its state stay alive. Bits of different globs never
    meet: a glob's first state is entered only at the start.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = sorted(rules, key=lambda r: (r.tier, -len(r.name), r.verdict != "block", r.name))
        slash, bits = ord("/"), 0
        step, stay, starts, finals = [], [], [], []  # per state: bytes that lead into it, bytes that keep it
        for rule in self.rules:
            starts.append(bits)
            step.append(np.zeros(256, bool))
            stay.append(np.zeros(256, bool))
            for kind, value in _tokens(rule.glob):
                if kind in ("run", "any"):
                    stay[-1] |= np.ones(256, bool) if kind == "any" else np.arange(256) != slash
                else:
                    step.append(np.arange(256) == value if kind == "byte" else np.arange(256) != slash)
                    stay.append(np.zeros(256, bool))
                    bits += 1
            finals.append(bits)
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.step, self.stay = self._pack(step), self._pack(stay)
        self.start, self.settled = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for b in starts:
            self.start[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        for b in finals:  # a final state that every byte keeps needs no more input
            if stay[b].all():
                self.settled[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        self.final = [(b // 64, np.uint64(1) << np.uint64(b % 64)) for b in finals]

    def _pack(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for b, accepted in enumerate(states):
            out[accepted, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Index in ``rules`` of the first rule that matches each whole text, or -1."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(size) - size
        live = np.repeat(self.start[None], len(texts), axis=0)
        rows, at = np.flatnonzero(size > 0), 0
        while len(rows):
            byte, d = flat[begin[rows] + at], live[rows]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[rows] = d = (moved & self.step[byte]) | (d & self.stay[byte])
            at += 1
            rows = rows[(size[rows] > at) & ((d & ~self.settled).any(axis=1))]
        first = np.full(len(texts), -1, np.int64)
        for k in range(len(self.rules) - 1, -1, -1):
            word, bit = self.final[k]
            first[(live[:, word] & bit) != 0] = k
        return first


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = GLOBS, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, glob of every row of ``pages``. No shuffle.

    ``rule`` is the longest of ``rules`` that fits, else null; then ``glob`` is the first
    of ``globs`` that fits, else null, and ``default`` decides. A null URL, or one without
    ``://``, has an empty host and path, so only a glob such as ``**`` could fit it.
    Repeated rows and null ids are judged like any other; other columns are not read.
    """
    packed = Automaton(tuple(rules) + tuple(globs))
    tiers = {r.name: r.tier for r in packed.rules}

    @F.pandas_udf("int")
    def first_rule(canonical: pd.Series) -> pd.Series:
        return pd.Series(packed.match([c.encode("utf-8", "replace") for c in canonical]), dtype="int32")

    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = parts.withColumn("_k", first_rule(F.concat(F.lit("."), "host", "path")))
    names = F.array(*(F.lit(r.name) for r in packed.rules))
    verdicts = F.array(*(F.lit(r.verdict) for r in packed.rules))
    ruled = F.array(*(F.lit(tiers[r.name] == 0) for r in packed.rules))
    k = F.col("_k")
    hit = k >= 0
    return found.select(
        "page_id",
        "host",
        "path",
        F.when(hit & F.get(ruled, k), F.get(names, k)).alias("rule"),
        F.when(hit, F.get(verdicts, k)).otherwise(F.lit(default)).alias("verdict"),
        F.when(hit & ~F.get(ruled, k), F.get(names, k)).alias("glob"),
    )
