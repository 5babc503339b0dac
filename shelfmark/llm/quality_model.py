"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of vote patterns estimates how each labeller votes on good
and on bad documents, with no labels given; a pattern's posterior is the soft label of its
documents. A linear scorer on hashed word and word-shape features is trained on a bounded
sample of them and then scores every document's whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BITS, SHAPE_BITS = 16, 12
SIZE = (1 << WORD_BITS) + (1 << SHAPE_BITS) + (1 << WORD_BITS) + 2  # words, shapes, pairs of shapes, two shares of repetition
#: Most rows of the training sample, those of least hash of id and text; all other counts cover all rows.
TRAIN_ROWS = 6000
#: Least score that is kept; below one half, as losing a good document costs more than keeping a bad one.
LEAST = 0.4
SYMBOLS = frozenset("#*$%&|<>{}[]\\~^_=")
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this from by not but or an which you had her all were when your said there use each she do how their if will up other about out many then them these so some would make like him into time has look two more go see no way could my than been who its now people le la les de des du et un une est que qui dans en pour pas sur avec ce il elle au aux par ne se plus son sa ses mais ou der die das und den dem ein eine ist von zu mit sich des auf nicht als auch es an werden aus er hat dass sie nach wird bei el los las del y que en un una por con para su al lo como pero sus le ya o este si porque esta entre cuando muy sin sobre".split()
)
LABELLERS = ("length", "symbols", "capitals", "repetition", "function words", "sentences", "word length")
ABSTAIN, BAD, GOOD = 0, 1, 2


class _Kinds(dict):
    """Code point -> A for a capital, a for another letter, 9 for a digit, else itself; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return found


_KINDS = _Kinds()
_MARKS = ".,;:!?\"'()"
_RUN = re.compile(r"(.)\1+", re.DOTALL)


class WordFacts(dict):
    """Word -> one integer: hashed word, hashed shape, and flags; emptied when it has grown too large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        kinds = word.translate(_KINDS)
        bare = word.lower().strip(_MARKS)
        flags = (bare in STOP_WORDS) | (kinds.count("A") > 1 and "a" not in kinds) << 1 | (not SYMBOLS.isdisjoint(word)) << 2 | (word[-1] in ".!?") << 3
        hashed = xxhash.xxh3_64_intdigest(bare) & ((1 << WORD_BITS) - 1)
        shaped = xxhash.xxh3_64_intdigest(_RUN.sub(r"\1", kinds), 1) & ((1 << SHAPE_BITS) - 1)
        self[word] = found = hashed | shaped << 16 | flags << 32 | min(len(word), 255) << 40
        return found


def word_codes(text: str | None, facts: WordFacts) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(facts.__getitem__, words), np.int64, len(words))


def distinct_triples(codes: np.ndarray) -> float:
    """Distinct triples of words as a share of all; 1 where none repeats."""
    triples = (codes[:-2] * 31 + codes[1:-1]) * 31 + codes[2:] if len(codes) > 2 else codes
    return len(np.unique(triples)) / max(len(triples), 1)


def votes(codes: np.ndarray) -> int:
    """The labellers' votes on one text as a number to base 3."""
    n = len(codes)
    if not n:
        return sum(BAD * 3**k for k in range(len(LABELLERS)))
    flags = codes >> 32 & 15
    stop, upper, symbol, ends = (float((flags >> k & 1).mean()) for k in range(4))
    length = float((codes >> 40).mean())
    distinct = distinct_triples(codes)

    def vote(good: bool, bad: bool) -> int:
        return GOOD if good else BAD if bad else ABSTAIN

    cast = (
        vote(n >= 50, n < 2),
        vote(symbol < 0.02, symbol > 0.1),
        vote(upper < 0.1, upper > 0.5),
        vote(n >= 20 and distinct > 0.8, n >= 20 and distinct < 0.5),
        vote(stop >= 0.1, n >= 20 and stop < 0.03),
        vote(0.01 <= ends <= 0.4, n >= 30 and ends < 0.004),
        vote(3 <= length <= 10, length < 2 or length > 14),
    )
    return sum(v * 3**k for k, v in enumerate(cast))


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): damped counts of words, word shapes and pairs of shapes, of unit length."""
    word, shape = codes & 0xFFFF, codes >> 16 & 0xFFF
    pairs = (shape[:-1] * 4099 + shape[1:]) & 0xFFFF
    index, count = np.unique(np.concatenate([word, (1 << WORD_BITS) + shape, (1 << WORD_BITS) + (1 << SHAPE_BITS) + pairs]), return_counts=True)
    value = np.log1p(count)
    value = value / max(float(np.sqrt((value**2).sum())), 1e-9)
    again = [1 - distinct_triples(codes), float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0]
    return np.append(index, [SIZE - 2, SIZE - 1]), np.append(value, again)


def estimate(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation maximisation over counts of vote patterns.

    Returns the posterior of being good by pattern, the table [class, labeller, vote] of
    vote probabilities (class 1 is good), and the share of good documents. Votes are taken
    as independent given the class. It starts from the share of good votes in a pattern.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], np.float64)
    cast = patterns[:, None] // 3 ** np.arange(labellers) % 3
    one_hot = np.eye(3)[cast]  # pattern, labeller, vote
    good = ((cast == GOOD).sum(1) + 0.5) / ((cast != ABSTAIN).sum(1) + 1)
    table, share = np.zeros((2, labellers, 3)), 0.5
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * weight
        share = float(both[1].sum() / weight.sum()) if len(weight) else 0.5
        table = np.einsum("cp,plv->clv", both, one_hot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        score = np.einsum("clv,plv->cp", np.log(table), one_hot) + np.log(np.clip([1 - share, share], 1e-6, 1))[:, None]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return dict(zip(patterns.tolist(), good.tolist())), table, share


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 120, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Weights (and bias, last) of a logistic scorer on soft targets; every row weighs the same."""
    weights, moment, second = np.zeros(SIZE + 1), np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(i) + 1 for i, _ in rows])
    index = np.concatenate([np.append(i, SIZE) for i, _ in rows])
    value = np.concatenate([np.append(v, 1.0) for _, v in rows])
    for step in range(1, rounds + 1):
        margin = np.bincount(owner, weights[index] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(rows)
        gradient = np.bincount(index, value * error[owner], SIZE + 1) + penalty * weights
        moment = 0.9 * moment + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights = weights - rate / np.sqrt(step) * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return weights


def margin(codes: np.ndarray, weights: np.ndarray) -> float:
    index, value = features(codes)
    return float(weights[index] @ value + weights[SIZE])


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, kinds: list, make) -> DataFrame:
    """mapInArrow over (doc_id, text): ``make(codes)`` gives the further fields of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = WordFacts()
        for batch in batches:
            rows = [make(word_codes(t.as_py(), facts)) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def candidates(docs: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, text) of the distinct rows of ``docs`` whose hash of id and text lies in the lowest ``share`` of all hashes.

    Rows that repeat id and text are one, met map-side, so that a row repeated without end
    takes one place. Null ids and texts hash like any other value.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    hashed = docs.select(F.xxhash64(F.struct(F.lit("sample"), doc_id, text)).alias("h"), text.alias("text"))
    near = hashed.where(F.col("h") < int((2 * share - 1) * (1 << 63))) if share < 1 else hashed
    return near.groupBy("h").agg(F.first("text").alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(scorer's weights, table of the labellers' vote probabilities [bad/good, labeller, abstain/bad/good]).

    The driver gets one count for each vote pattern (at most 3**7) and the features of at
    most ``train_rows`` documents, those of least hash: the same for any order of rows.
    """
    cast = _mapped(docs, id_col, text_col, "doc_id long, pattern int", [pa.int32()], lambda c: (votes(c),))
    counts = {r["pattern"]: r["n"] for r in cast.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, table, _ = estimate(counts)
    schema = "h long, pattern int, index array<int>, value array<float>"
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
    share = 1.5 * (train_rows + 100) / max(1, sum(counts.values()))
    while True:  # more than once only where most rows repeat others
        near = _mapped(candidates(docs, share, id_col, text_col), "h", "text", schema, kinds, lambda c: (votes(c), *features(c)))
        rows = near.orderBy("h").limit(train_rows).collect()
        if len(rows) == train_rows or share >= 1:
            break
        share *= 16
    target = np.array([posterior[r["pattern"]] for r in rows])
    return fit([(np.array(r["index"], np.int64), np.array(r["value"])) for r in rows], target), table


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, least: float = LEAST) -> DataFrame:
    """doc_id, score (0 to 1), kept (score at least ``least``) of every row of ``docs``, by a scorer trained on ``docs``.

    A null text, or one without words, scores 0. Repeated rows and null ids are scored
    like any other; an empty table gives an empty result; other columns are not read.
    """
    weights, _ = train(docs, id_col, text_col, train_rows)
    light = weights.astype(np.float32)  # half a megabyte, whatever the corpus

    def one(codes: np.ndarray) -> tuple[float]:
        return (1 / (1 + float(np.exp(-np.clip(margin(codes, light), -30, 30)))) if len(codes) else 0.0,)

    return _mapped(docs, id_col, text_col, "doc_id long, score double", [pa.float64()], one).withColumn("kept", F.col("score") >= least)
