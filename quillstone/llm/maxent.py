"""Language-model scoring with a hashed maximum-entropy model.

Tokens are words in lower case (A-Z), then one end a text. The vocabulary is counted over all
training texts. A token's probability is that of its class, times that of its slot in the class,
each from a softmax over hashed features of the tokens before it: the one before, the two before
together, and the second and third before by themselves, which skips. A class's commonest tokens
have a slot each; the others share one, in which a token's share is by add-half counts.

Classes come from contexts: common tokens are grouped by the commonest tokens that stand beside
them, and a group is cut into classes of equal mass by frequency. All other tokens are in tail
classes by hash, each with one unseen token and shares by add-half counts.

Both softmaxes begin at damped log ratios of counts, and are trained by rounds of gradient
updates: each task adds up observed and expected counts over every token of its texts, the sums
meet slice by slice, and the difference, scaled by the counts, moves the weights. Expected counts
are added as integers, so the model doesn't depend on how texts are dealt to tasks.

The counts of frequent tokens (a fixed number) are broadcast; all other counts are joined.

Defined results: a null or empty text is one end; without training texts all counts are 0 and the
classes are equally likely; repeated rows score alike, rows with equal ids are separate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._tables import settled

#: Tokens whose counts are broadcast; classes, the last of which are for all other tokens; slots of a class.
FREQUENT, CLASSES, TAIL, SLOTS = 1 << 17, 32, 8, 32
#: Tokens that are grouped by context, tokens that make a context, how far they reach, and groups.
GROUPED, BESIDE, REACH, GROUPS = 1 << 15, 64, 2, 8
#: Tokens that a group may begin at.
FIRST = 1024
#: Hashed feature rows, features a token, tokens a step, and of these so many at a time, whose numbers stay in a core's cache.
ROWS, FEATURES, STEP, FEW = 1 << 15, 4, 1 << 16, 1 << 11
#: Sorted tokens are found by so many of their first bits; cells of a table that a task holds before it counts them.
BITS, CELLS = 19, 1 << 22
#: No weight is larger.
BOUND = 10.0
#: Rounds of gradient updates, their rate, the damping of the start, and the counts that smooth both.
ROUNDS, RATE, START_SHARE, SMOOTH = 1, 0.5, 0.5, 20.0
#: Expected counts are added in steps of one part in so many.
PARTS = 1 << 16
#: Slices in which tasks return their sums; tasks of a round (more on a larger cluster, up to MOST).
SLICES, WORKERS, MOST = 16, 16, 1024
#: Distinct tokens that a task counts before it passes them on.
HELD = 1 << 20
END, START = np.uint64(1), np.uint64(2)


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # frequent tokens, sorted
    counts: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    inside: np.ndarray  # CLASSES: log10 of 1 / (mass of what shares a slot), or of a tail class
    prior: np.ndarray  # CLASSES: log of the classes' shares
    slot_prior: np.ndarray  # CLASSES x SLOTS: log of the slots' shares
    total: int  # N
    distinct: int  # V
    weights: np.ndarray  # ROWS x CLASSES
    slot_weights: np.ndarray  # ROWS x SLOTS

    @cached_property
    def begins(self) -> np.ndarray:
        return begins(self.tokens)

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of the weights, of the slots' weights and of the slots' prior.

        A class's prior is dealt to the features. Weights and priors are bounded, so a product of
        `FEATURES` of them and a prior is within single precision.
        """
        return np.exp(self.weights + self.prior / np.float32(FEATURES)), np.exp(self.slot_weights), np.exp(self.slot_prior)


def lowered(texts: G.Texts) -> G.Texts:
    data = texts.data
    return G.Texts(data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)), texts.offs)


def stream(texts: G.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts, with each text's end, and the texts' offsets."""
    low = lowered(texts)
    starts, ends, offs = low.words()
    words = low.word_hashes(starts, ends)
    at = offs + np.arange(len(offs))
    out = np.full(at[-1], END, G.U)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = words
    return out, at


def begins(tokens: np.ndarray) -> np.ndarray:
    """For each value of the first `BITS` bits the place of the first sorted token that has no smaller one (or the last place)."""
    return np.minimum(np.searchsorted(tokens, np.arange(1 << BITS, dtype=G.U) << G.U(64 - BITS)), len(tokens) - 1).astype(np.int32)


def placed(tokens: np.ndarray, first: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each found token among the sorted ones, whose `begins` are given; that of any other, if it isn't there."""
    place = first.take((found >> G.U(64 - BITS)).view(np.int64)).astype(np.int64)
    later = np.flatnonzero(tokens.take(place) < found)
    place[later] = np.minimum(np.searchsorted(tokens, found[later]), len(tokens) - 1)
    return place


class Tally:
    """How often each cell of a table is seen; cells are held until there are `CELLS`, so that a large table isn't gone through for a few."""

    def __init__(self, rows: int, width: int):
        self.table, self.width, self.held, self.size = np.zeros(rows * width, np.int64), width, [], 0

    def add(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.held.append((rows * self.width + columns).ravel().astype(np.int32))
        self.size += self.held[-1].size
        if self.size >= CELLS:
            self.count()

    def count(self) -> None:
        if self.size:
            self.table += np.bincount(np.concatenate(self.held), minlength=self.table.size)
        self.held, self.size = [], 0

    def total(self) -> np.ndarray:
        self.count()
        return self.table.reshape(-1, self.width)


def count_tokens(texts: DataFrame) -> DataFrame:
    """token, n over all rows of a column `text`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate(held), return_inverse=True)
            return every, np.bincount(where, np.concatenate(numbers)).astype(np.int64)

        def batch(tokens: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(n)], ["token", "n"])

        for _, part in G.batches(frames):
            tokens, n = np.unique(stream(part)[0], return_counts=True)
            held.append(tokens)
            numbers.append(n)
            size += len(tokens)
            if size > 2 * HELD:
                tokens, n = merged()
                held, numbers, size = [tokens], [n], len(tokens)
                if size > HELD:
                    yield batch(tokens, n)
                    held, numbers, size = [], [], 0
        if held:
            yield batch(*merged())

    return settled(texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, most: int | None = None) -> np.ndarray:
    """(token, count) of the tokens above the lowest count that at most `most` reach, commonest first.

    Counts fall into steps of a sixty-fourth of their logarithm, whose histogram is small at any
    size; so the driver gets these tokens once, and not each task's candidates.
    """
    most = FREQUENT if most is None else most
    step = F.floor(F.log2("n") * 64).cast("int")
    left, lowest = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        lowest = r["step"]
    rows = counts.where(step >= lowest).select("token", "n").collect() if lowest is not None else []
    top = np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
    return top[np.lexsort((top[:, 0], -top[:, 1]))]


def neighbours(texts: DataFrame, top: np.ndarray) -> np.ndarray:
    """For each of the first `GROUPED` tokens how often each of the first `BESIDE` stands within `REACH` places of it."""
    if not len(top):
        return np.zeros((GROUPED, BESIDE), np.int64)
    tokens = top[:GROUPED, 0].view(np.uint64)
    order = np.argsort(tokens)
    return summed(texts, partial(beside, tokens[order], order), [(GROUPED, BESIDE)])[0]


def beside(tokens: np.ndarray, ranks: np.ndarray, parts: Iterator[G.Texts]) -> list[np.ndarray]:
    """The counts of `neighbours` in some texts; tokens are sorted and have these ranks."""
    tally, first = Tally(GROUPED, BESIDE), begins(tokens)
    for part in parts:
        found, at = stream(part)
        where = placed(tokens, first, found)
        number = np.where(tokens.take(where) == found, ranks.take(where), GROUPED)
        owner = np.repeat(np.arange(part.n), np.diff(at))
        for k in range(1, REACH + 1):
            left, right, same = number[:-k], number[k:], owner[:-k] == owner[k:]
            for token, other in ((left, right), (right, left)):
                ok = same & (token < GROUPED) & (other < BESIDE)
                tally.add(token[ok], other[ok])
    return [tally.total()]


def grouped(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A group for each token, by k-means over the square roots of its neighbours' shares; fixed starts, far from each other."""
    if not len(counts):
        return np.zeros(0, np.int64)
    usual = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * BESIDE)
    shares = counts + usual
    shares = np.sqrt(shares / shares.sum(1, keepdims=True)).astype(np.float32)
    sure = weight * (counts.sum(1) > 0)
    centres = shares[[0]]
    for _ in range(1, min(GROUPS, len(shares))):
        far = (1 - (shares[:FIRST] @ centres.T).max(1)) * np.sqrt(sure[:FIRST])
        centres = np.concatenate([centres, shares[[int(far.argmax())]]])
    for _ in range(12):
        group = (shares @ centres.T).argmax(1)
        for g in range(len(centres)):
            mean = (shares[group == g] * np.sqrt(sure[group == g])[:, None]).sum(0)
            size = float(np.linalg.norm(mean))
            if size:
                centres[g] = mean / size
    return (shares @ centres.T).argmax(1)


def untrained(texts: DataFrame, counts: DataFrame) -> Model:
    """The model with its vocabulary, classes and slots, from the counts of all training tokens."""
    tail = F.pmod("token", F.lit(TAIL)).cast("int")
    sums = {r[0]: (r[1], r[2]) for r in counts.groupBy(tail).agg(F.sum("n"), F.count("*")).collect()}
    top = frequent(counts)
    near = min(GROUPED, len(top))
    group = grouped(neighbours(texts, top)[:near], top[:near, 1].astype(float))
    return arranged(top, group, np.array([sums.get(k, (0, 0)) for k in range(TAIL)], np.int64))


def arranged(top: np.ndarray, group: np.ndarray, own: np.ndarray) -> Model:
    """From (token, count) commonest first, the groups of the first of them, and (count, number) of all tokens of each tail class."""
    total, distinct, near = int(own[:, 0].sum()), int(own[:, 1].sum()), len(group)
    head, masses = CLASSES - TAIL, np.bincount(group, top[:near, 1], GROUPS)
    bands = np.ones(GROUPS, np.int64)
    for _ in range(head - GROUPS):
        bands[(masses / bands).argmax()] += 1
    begins = np.cumsum(bands) - bands
    classes = (head + top[:, 0] % TAIL).astype(np.int32)
    slots = np.zeros(len(top), np.int32)
    for g in range(GROUPS):
        mine = np.flatnonzero(group == g)
        n = top[mine, 1]
        before = np.cumsum(n) - n / 2
        classes[mine] = begins[g] + np.minimum(bands[g] - 1, (before / max(1, n.sum()) * bands[g]).astype(np.int64))
    for c in range(head):
        mine = np.flatnonzero(classes[:near] == c)[: SLOTS - 1]
        slots[mine] = 1 + np.arange(len(mine))
    rest = top[:near, 0] % TAIL
    own = own.copy()
    own[:, 0] -= np.bincount(rest, top[:near, 1], TAIL).astype(np.int64)
    own[:, 1] -= np.bincount(rest, minlength=TAIL)
    mass = np.zeros((CLASSES, SLOTS))
    np.add.at(mass, (classes[:near], slots[:near]), top[:near, 1] + 0.5)
    mass[head:, 0] = own[:, 0] + 0.5 * (own[:, 1] + 1)
    if not total:
        mass[:, 0] = 0.5
    with np.errstate(divide="ignore"):
        whole = mass.sum(1)
        prior = np.log(whole / whole.sum())
        slot_prior = np.log(mass / np.maximum(whole, 1e-9)[:, None])
    order = np.argsort(top[:, 0].view(np.uint64))
    return Model(top[order, 0].view(np.uint64), top[order, 1], classes[order], slots[order], -np.log10(np.maximum(mass[:, 0], 0.5)), np.maximum(prior, -60).astype(np.float32), np.maximum(slot_prior, -60).astype(np.float32), total, distinct, np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32))


def known(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's class and slot, whether it is frequent, and its count if so."""
    tail = (CLASSES - TAIL + (tokens.view(np.int64) % TAIL)).astype(np.int32)
    if not len(model.tokens):
        return tail, np.zeros(len(tokens), np.int32), np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    place = placed(model.tokens, model.begins, tokens)
    found = model.tokens.take(place) == tokens
    return np.where(found, model.classes.take(place), tail), np.where(found, model.slots.take(place), 0), found, np.where(found, model.counts.take(place), 0)


def features(tokens: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The feature rows of the tokens at some places."""
    owner = np.searchsorted(at, places, side="right") - 1
    inside = places - at[owner]
    return hashed([np.where(inside >= k, tokens[np.maximum(0, places - k)], START) for k in (1, 2, 3)]).T


def hashed(before: list[np.ndarray]) -> np.ndarray:
    """FEATURES x n: the feature rows after the last, the second and the third token before."""
    mixed = (before[0] * G.U(0x9E3779B97F4A7C15), before[0] * G.U(0xC2B2AE3D27D4EB4F) + before[1] * G.U(0x165667B19E3779F9), before[1] * G.U(0xD6E8FEB86659FD93), before[2] * G.U(0xA0761D6478BD642F))
    out = np.empty((FEATURES, len(before[0])), np.int64)
    for k, m in enumerate(mixed):
        out[k] = (G.mix(m + G.U(k)) & G.U(ROWS - 1)).view(np.int64)
    return out


def befores(tokens: np.ndarray, at: np.ndarray, i: int, j: int) -> list[np.ndarray]:
    """For the places from i to j the last, the second and the third token before each in its text."""
    out = []
    for k in (1, 2, 3):
        one, there = np.full(j - i, START, G.U), tokens[max(0, i - k) : max(0, j - k)]
        one[len(one) - len(there) :] = there
        for n in range(k):
            places = at[:-1] + n
            one[places[(places < at[1:]) & (places >= i) & (places < j)] - i] = START
        out.append(one)
    return out


def slot_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The feature rows of the softmax within the tokens' classes."""
    return (rows * np.int32(5) + (classes * np.int32(7919))[:, None] + np.int32(1)) & np.int32(ROWS - 1)


def _products(factors: np.ndarray, rows: np.ndarray, prior: np.ndarray | None, classes: np.ndarray | None) -> Iterator[tuple[slice, np.ndarray]]:
    """For `FEW` lines at a time the products of the factors that a line's feature rows have; and of its class's prior, if that is given."""
    for i in range(0, rows.shape[1], FEW):
        here = slice(i, i + FEW)
        out = factors.take(rows[0, here], axis=0)
        for k in range(1, FEATURES):
            out *= factors.take(rows[k, here], axis=0)
        if prior is not None:
            out *= prior.take(classes[here], axis=0)
        yield here, out


def _log10_of(factors: np.ndarray, rows: np.ndarray, chosen: np.ndarray, prior: np.ndarray | None = None, classes: np.ndarray | None = None) -> np.ndarray:
    """The log10 probability of the chosen one in each line's softmax."""
    out = np.empty(len(chosen), np.float32)
    for here, products in _products(factors, rows, prior, classes):
        out[here] = np.log10(products[np.arange(len(products)), chosen[here]]) - np.log10(products.sum(1))
    return out


def _parts(factors: np.ndarray, rows: np.ndarray, prior: np.ndarray | None = None, classes: np.ndarray | None = None) -> np.ndarray:
    """width x n: the softmax of each line in whole `PARTS`."""
    out = np.empty((factors.shape[1], rows.shape[1]), np.float32)
    for here, products in _products(factors, rows, prior, classes):
        turned = np.ascontiguousarray(products.T)
        turned *= np.float32(PARTS) / products.sum(1)
        np.rint(turned, out=out[:, here])
    return out


def steps(tokens: np.ndarray, at: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, classes, which are head classes, class rows, slot rows) of `STEP` tokens at a time.

    Rows are FEATURES x n; slot rows are those of tokens in head classes only.
    """
    for i in range(0, len(tokens), STEP):
        c = classes[i : i + STEP]
        rows = hashed(befores(tokens, at, i, i + len(c)))
        head = np.flatnonzero(c < CLASSES - TAIL)
        yield i, c, head, rows, slot_rows(rows.take(head, axis=1).T, c[head]).T


def observed(model: Model, parts: Iterator[G.Texts]) -> list[np.ndarray]:
    """How often each feature row has each class, and each slot, over every token of some texts."""
    out = Tally(ROWS, CLASSES), Tally(ROWS, SLOTS)
    for texts in parts:
        tokens, at = stream(texts)
        classes, slots, _, _ = known(model, tokens)
        for i, c, head, rows, inner in steps(tokens, at, classes):
            out[0].add(rows, c)
            out[1].add(inner, slots[i + head])
    return [tally.total() for tally in out]


def expected(model: Model, parts: Iterator[G.Texts]) -> list[np.ndarray]:
    """What the model expects of the same counts, in `PARTS` of one: whole numbers, so their order doesn't matter."""
    out = [np.zeros((CLASSES, ROWS)), np.zeros((SLOTS, ROWS))]
    outer, slot, slot_prior = model.factors
    for texts in parts:
        tokens, at = stream(texts)
        for _, c, head, rows, inner in steps(tokens, at, known(model, tokens)[0]):
            for table, where, given in ((out[0], rows, (outer, rows)), (out[1], inner, (slot, inner, slot_prior, c[head]))):
                flat, each = where.ravel(), np.empty(where.shape)
                for line, p in zip(table, _parts(*given), strict=True):
                    each[:] = p
                    line += np.bincount(flat, each.ravel(), ROWS)
    return [np.ascontiguousarray(table.T).astype(np.int64) for table in out]


def summed(texts: DataFrame, one: Callable[[Iterator[G.Texts]], list[np.ndarray]], shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The sums of the integer tables that `one` makes of each task's texts; tasks return them in slices, which meet by number."""
    context = texts.sparkSession.sparkContext
    held = context.broadcast(one)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value(part for _, part in G.batches(frames))
        for k in range(SLICES):
            pieces = [np.split(t, SLICES)[k].astype("<i8").tobytes() for t in tables]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["slice", "number", "sums"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(0, np.int64)
        for x in part["sums"]:
            more = np.frombuffer(x.as_py(), "<i8")
            total = total + more if len(total) else more
        return pa.table({"slice": [key[0].as_py()], "number": [key[1].as_py()], "sums": [total.tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("number", pa.int32()), ("sums", pa.binary())]))

    workers = min(MOST, max(WORKERS, context.defaultParallelism))
    shape = "slice int, number int, sums binary"
    found = {(r[0], r[1]): r[2] for r in texts.select("text").coalesce(workers).mapInArrow(run, shape).groupBy("slice", "number").applyInArrow(add, shape).collect()}
    return [np.concatenate([np.frombuffer(found[k, i], "<i8") if (k, i) in found else np.zeros(rows // SLICES * width, np.int64) for k in range(SLICES)]).reshape(rows, width) for i, (rows, width) in enumerate(shapes)]


SHAPES = [(ROWS, CLASSES), (ROWS, SLOTS)]


def started(model: Model, seen: list[np.ndarray]) -> Model:
    """Weights at damped log ratios of what a feature has seen to what all tokens have."""
    out = []
    for table in seen:
        share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * table.shape[1])
        n = table.sum(1, keepdims=True)
        out.append(np.clip(START_SHARE * np.log((table + SMOOTH * share) / ((n + SMOOTH) * share)), -BOUND, BOUND).astype(np.float32))
    return replace(model, weights=out[0], slot_weights=out[1])


def moved(model: Model, seen: list[np.ndarray], thought: list[np.ndarray]) -> Model:
    """One gradient update: observed less expected counts, scaled by both."""
    out = []
    for weights, table, guess in zip((model.weights, model.slot_weights), seen, thought, strict=True):
        guess = guess / PARTS
        out.append(np.clip(weights + 2 * RATE * (table - guess) / (table + guess + SMOOTH), -BOUND, BOUND).astype(np.float32))
    return replace(model, weights=out[0], slot_weights=out[1])


def train(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    model = untrained(texts, counts)
    if not model.total:
        return model
    seen = summed(texts, partial(observed, model), SHAPES)
    model = started(model, seen)
    for _ in range(rounds):
        model = moved(model, seen, summed(texts, partial(expected, model), SHAPES))
    return model


def local_scores(model: Model, texts: G.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """What the model alone says of each text, and its tokens whose counts must be joined (with offsets).

    `score` lacks, and `base` too, the logarithm of the joined tokens' counts.
    """
    tokens, at = stream(texts)
    classes, slots, frequent, counts = known(model, tokens)
    outer, slot, slot_prior = model.factors
    score = np.zeros(len(tokens))
    for i, c, head, rows, inner in steps(tokens, at, classes):
        score[i : i + len(c)] = _log10_of(outer, rows, c)
        score[i + head] += _log10_of(slot, inner, slots[i + head], slot_prior, c[head])
    shared = slots == 0
    score += np.where(shared, model.inside[classes], 0.0)
    log = np.where(frequent, np.log10(counts + 0.5), 0.0)
    n = np.diff(at)
    base = G.span_sums(log, at) - n * np.log10(model.total + 0.5 * (model.distinct + 1))
    left = np.flatnonzero(~frequent)
    return {"n_tokens": n, "n_known": G.span_sums(frequent.astype(np.int64), at), "base": base, "score": G.span_sums(score + np.where(shared, log, 0.0), at)}, tokens[left].view(np.int64), np.searchsorted(left, at)


def score_texts(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            found, left, at = local_scores(held.value, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[k]) for k in ("n_tokens", "n_known", "base", "score")), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(left))], ["doc_id", "n_tokens", "n_known", "base", "score", "left"])

    local = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, left array<long>")
    local = settled(local.withColumn("row", F.monotonically_increasing_id()))
    joined = local.select("row", F.explode("left").alias("token")).join(counts, "token", "left")
    more = joined.groupBy("row").agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"))
    both = local.drop("left").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return both.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))


def score_all(documents: DataFrame, training: Column) -> DataFrame:
    """Learns from the documents for which `training` is true and scores all."""
    texts = documents.where(training)
    counts = count_tokens(texts)
    model = train(texts, counts)
    return score_texts(documents, model, counts).withColumn("train_tokens", F.lit(model.total).cast("long"))
