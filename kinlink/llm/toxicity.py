"""Toxicity by a factorization machine over hashed terms."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import words as W

BUCKETS = 1 << 18
FACTORS = 8
# The most labelled documents that training reads, those with the least hash of the id.
SAMPLE = 24_000
# A bucket counts if as many documents of the sample hold it, and if it tells something: alone
# it is this many standard errors more or less frequent in toxic ones, or together with another
# one so many more than the two are by themselves. The rest is noise that long texts would add up.
LEAST_DOCS = 5
LEAST_Z = 3.0
LEAST_PAIR_Z = 8.0
# The most frequent buckets, whose pairs are looked at.
PAIR_BUCKETS = 2048
# Stems: beginnings of words, in bytes, that count as terms beside the word itself.
STEMS = (4, 5)
# Batches that training takes at least; few labels are gone through more often.
LEAST_STEPS = 300


def _terms(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the terms of each text of a slice, repeats included, ordered by text.

    Terms are the words, runs of letters, digits and non-ASCII bytes, and their stems.
    """
    parts = np.zeros(256, bool)
    parts[48:58] = parts[65:91] = parts[97:123] = parts[128:] = True
    starts, ends, owner = W.word_spans(data, offsets, parts)
    until, whose = [ends], [owner]
    begin, kind = [starts], [np.zeros(len(starts), np.uint64)]
    for size in STEMS:
        long = ends - starts >= size
        begin.append(starts[long])
        until.append(starts[long] + size)
        whose.append(owner[long])
        kind.append(np.full(int(long.sum()), size, np.uint64))
    hashes = W.word_hashes(data, np.concatenate(begin), np.concatenate(until))
    buckets = W.mix(hashes + np.concatenate(kind)) & np.uint64(BUCKETS - 1)
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return buckets[order], whose[order]


def term_buckets(texts: DataFrame) -> DataFrame:
    """(id, terms) from (id, text): the distinct term buckets of each whole text."""

    def hashed(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(offsets):
                buckets, owner = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                buckets, owner = W.distinct(buckets, owner, b - a)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), W.list_column(buckets.astype(np.int32), owner, b - a, pa.int32())],
                    ["id", "terms"],
                )

    return texts.mapInArrow(W.tidy(hashed), "id long, terms array<int>")


def telling_pairs(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which of ``buckets`` tell something of toxicity in a pair with another one of them.

    A pair's count in toxic texts is compared with what follows from its count in all texts and
    the two buckets' own excess, by which a pair of two terms that tell nothing alone, but
    something together, stands out.
    """
    m = len(buckets)
    place = np.full(BUCKETS, -1, np.int64)
    place[buckets] = np.arange(m)
    both, bad = np.zeros((m, m)), np.zeros((m, m))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), 2000):
        b = min(a + 2000, len(sizes))
        own = place[flat[edges[a] : edges[b]]]
        row = np.repeat(np.arange(b - a), sizes[a:b])
        cells = np.zeros((b - a, m), np.float32)
        cells[row[own >= 0], own[own >= 0]] = 1
        both += cells.T @ cells
        toxic = cells[labels[a:b] > 0]
        bad += toxic.T @ toxic
    rate = labels.mean()
    single = np.diag(both).copy()
    lift = np.divide(np.diag(bad), single, out=np.full(m, rate), where=single > 0) - rate
    # Shrunk towards the rate, as rare pairs say little.
    expected = np.clip(rate + lift[:, None] + lift[None, :], 0.02, 0.98)
    z = (bad - both * expected) / np.sqrt(both * expected * (1 - expected) + 1)
    np.fill_diagonal(z, 0)
    z[both < 4 * LEAST_DOCS] = 0
    return (np.abs(z) >= LEAST_PAIR_Z).any(1)


class Machine:
    """bias + sum of w + sum over pairs of <v_i, v_j>, over the buckets a text holds.

    Only the buckets that count have a weight and factors; ``place`` is where, 0 for the rest.
    """

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.buckets, self.weights, self.factors = bias, buckets, weights, factors
        self.place = np.zeros(BUCKETS, np.int32)
        self.place[buckets] = np.arange(1, len(buckets) + 1)

    def scores(self, buckets: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Of texts with these distinct buckets, all of which count."""
        at = self.place[buckets] - 1
        margin = np.bincount(owner, self.weights[at], owners) + self.bias
        for column in self.factors[at].T:
            total = np.bincount(owner, column, owners)
            margin += 0.5 * (total * total - np.bincount(owner, column * column, owners))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(
    flat: np.ndarray,
    sizes: np.ndarray,
    labels: np.ndarray,
    factors: int = FACTORS,
    epochs: int = 8,
    rate: float = 0.1,
    penalty: float = 1e-4,
    batch: int = 256,
    seed: int = 1,
) -> Machine:
    """Adagrad on the log loss, in batches, over the buckets that ``LEAST_DOCS`` and ``LEAST_Z`` leave.

    ``flat`` has the buckets of all texts one after the other, ``sizes`` their number in each.
    """
    rng = np.random.default_rng(seed)
    if not len(labels):
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    held = np.bincount(flat, minlength=BUCKETS)
    in_bad = np.bincount(flat, np.repeat(labels, sizes), BUCKETS)
    bad, good = max(labels.sum(), 1), max(len(labels) - labels.sum(), 1)
    share = np.clip(held / len(labels), 1e-9, 1 - 1e-9)
    z = (in_bad / bad - (held - in_bad) / good) / np.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    common = (held >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
    often = np.argsort(-held, kind="stable")[:PAIR_BUCKETS]
    often = often[held[often] >= 4 * LEAST_DOCS]
    if 0 < labels.sum() < len(labels) and len(often):
        common[often[telling_pairs(flat, sizes, labels, often)]] = True
    buckets = np.flatnonzero(common)
    used = common[flat]
    whose = np.repeat(np.arange(len(labels)), sizes)[used]
    flat = (np.cumsum(common) - 1)[flat[used]]
    edges = np.searchsorted(whose, np.arange(len(labels) + 1))
    m = len(buckets)
    weights, v = np.zeros(m), rng.normal(0, 0.01, (m, factors))
    toxic = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(toxic / (1 - toxic)))
    grown_w, grown_v, grown_b = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(labels)))):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            cells = np.concatenate([flat[edges[r] : edges[r + 1]] for r in rows])
            owner = np.repeat(np.arange(len(rows)), edges[rows + 1] - edges[rows])
            here, code = np.unique(cells, return_inverse=True)
            w, vv = weights[here], v[here]
            cell = vv[code]
            total = np.stack([np.bincount(owner, cell[:, f], len(rows)) for f in range(factors)], 1)
            square = np.bincount(owner, (cell * cell).sum(1), len(rows))
            margin = bias + np.bincount(owner, w[code], len(rows)) + 0.5 * ((total**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = error[owner]
            grad_w = np.bincount(code, each, len(here)) + penalty * w
            pull = each[:, None] * (total[owner] - cell)
            grad_v = np.stack([np.bincount(code, pull[:, f], len(here)) for f in range(factors)], 1) + penalty * vv
            grown_w[here] += grad_w**2
            grown_v[here] += grad_v**2
            weights[here] = w - rate * grad_w / np.sqrt(grown_w[here])
            v[here] = vv - 0.3 * rate * grad_v / np.sqrt(grown_v[here])
            grad_b = error.sum()
            grown_b += grad_b**2
            bias -= rate * grad_b / np.sqrt(grown_b)
    return Machine(bias, buckets, weights, v)


def held_out(id_column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves the remainder ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Machine:
    """Fit on at most ``SAMPLE`` labelled documents that are not held out, in one task.

    The machine comes back as one row for each bucket that counts, at most ``BUCKETS``. Of several labels of one document the largest counts. The ids of the sample are the only
    thing that is broadcast; their number is bounded by ``SAMPLE``.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column, 3, 1))
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(known.select("id")), "id").select("id", "text")
    known = F.broadcast(known)
    sample = term_buckets(picked).join(known, "id").repartition(1)

    def learned(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        terms = table["terms"].combine_chunks()
        machine = fit(terms.flatten().to_numpy(), np.diff(terms.offsets.to_numpy()), table["toxic"].to_numpy().astype(float))
        buckets = np.concatenate([[-1], machine.buckets])
        weights = np.concatenate([[machine.bias], machine.weights])
        factors = np.concatenate([np.zeros((1, machine.factors.shape[1])), machine.factors])
        yield pa.record_batch(
            [pa.array(buckets, pa.int32()), pa.array(weights), pa.array(list(factors), pa.list_(pa.float64()))],
            ["bucket", "weight", "factors"],
        )

    rows = sample.select("id", "terms", "toxic").mapInArrow(W.tidy(learned), "bucket int, weight double, factors array<double>")
    found = rows.orderBy("bucket").toArrow()
    if not len(found):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    factors = np.stack(found["factors"].to_numpy())
    buckets, weights = found["bucket"].to_numpy(), found["weight"].to_numpy()
    return Machine(float(weights[0]), buckets[1:], weights[1:], factors[1:])


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every whole text; null, empty and blank texts get the score of no terms."""
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.buckets, machine.weights, machine.factors))

    def scored(batches):
        own = Machine(*model.value)
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            found = np.zeros(len(batch))
            for a, b in W.slices(offsets):
                buckets, owner = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                used = own.place[buckets] > 0
                buckets, owner = W.distinct(buckets[used], owner[used], b - a)
                found[a:b] = own.scores(buckets, owner, b - a)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["id", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(W.tidy(scored), "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each document; predicted is 1 from a score of 0.7 on.

    Learns only from labelled documents outside the held-out third, and scores by text alone.
    Each row is scored by itself, so repeated rows get equal scores; a null id is not held out.
    Without labels every score is that of an untrained machine, 0.5. Empty tables give no rows.
    """
    out = score(docs, train(docs, labels, id_column, text_column), id_column, text_column)
    return out.select(
        F.col("id").alias(id_column),
        held_out("id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
