"""Mixing by soft membership: a classifier gives each document domain shares, projected gradient fits document rates to targets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import released, steps, stored, text_buffer, word_hashes, word_spans

#: Domains by label: toxic documents, else by quality.
DOMAINS = ("high", "low", "toxic")
#: Share of all tokens that each domain shall have in the mixture.
TARGETS = {"high": 0.90, "low": 0.09, "toxic": 0.01}
#: Labelled documents per domain that the classifier is fitted on (a documented bound).
TRAIN_DOCS = 800
BUCKET_BITS = 14
SHAPES = 6
#: The fit ends at this miss (of all tokens), or where the squared miss has fallen by less than STILL of itself in PATIENCE steps: the
#: targets cannot be met any better. STEPS only ends a fit that does neither.
TOLERANCE, STILL, PATIENCE, STEPS = 1e-6, 1e-3, 6, 100
#: Lengths at which a step is tried.
LENGTHS = (4.0, 2.0, 1.0, 0.5, 0.2, 0.05)


@dataclass
class Classifier:
    weights: np.ndarray  # (buckets + shapes + 1, domains)


def _counts(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks set between each two bounds."""
    total = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, dtype=total.dtype, out=total[1:])
    return np.diff(total[bounds])


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each word, first word of each text, words per text, shape features) for runs of texts.

    Shapes: shares of capitals, digits, other ASCII marks, non-ASCII bytes, repeated neighbours two words apart, mean word length.
    """
    data, offsets = text_buffer(column)
    for i, j in steps(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_spans(part, bounds)
        h = word_hashes(part, starts, ends)
        n, size = np.diff(first), np.maximum(np.diff(bounds), 1)
        capital, digit = (part >= 65) & (part <= 90), (part >= 48) & (part <= 57)
        small, high = (part >= 97) & (part <= 122), part >= 128
        mark = ~(capital | digit | small | high) & (part > 32)
        share = [_counts(x, bounds) / size for x in (capital, digit, mark, high)]
        again = np.r_[h[1:] == h[:-1], False] if len(h) else np.zeros(0, bool)
        share.append(_counts(again, first) / np.maximum(n, 1))
        share.append(np.log1p(size / np.maximum(n, 1)) / 4)
        yield (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first, n, np.stack(share, axis=1)


def _logits(c: Classifier, bucket: np.ndarray, first: np.ndarray, n: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(n)), n)
    total = np.stack([np.bincount(own, c.weights[bucket, k], len(n)) for k in range(c.weights.shape[1])], axis=1)
    return total / np.sqrt(np.maximum(n, 1))[:, None] + shapes @ c.weights[1 << BUCKET_BITS : -1] + c.weights[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Classifier:
    """Multinomial logistic regression on hashed words of about ``train_docs`` labelled documents of each domain.

    The labels are drawn by a hash of their id and joined to the documents; features are made in tasks and the driver
    gets word buckets of the bounded sample. Without labels every domain is equally likely.
    """
    domain = F.when(F.col("toxic") == 1, DOMAINS.index("toxic")).when(F.col("quality") == 1, DOMAINS.index("high"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.select(F.col(id_col).alias("id"), domain.otherwise(DOMAINS.index("low")).alias("domain"))
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(((1 << BUCKET_BITS) + SHAPES + 1, len(DOMAINS)))
    if not sizes:
        return Classifier(weights)
    share = F.lit(0)
    for k, n in sizes.items():
        share = F.when(F.col("domain") == k, F.lit(min(1_000_000, int(1_000_000 * train_docs / n) + 1))).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    # Bounded by train_docs per domain, so it may be sent to every task.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for bucket, first, n, shapes in _features(batch.column(2)):
                keys, counts = [], []
                for i in range(len(n)):
                    k, c = np.unique(bucket[first[i] : first[i + 1]], return_counts=True)
                    keys.append(k.astype(np.int32).tobytes())
                    counts.append(c.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(keys), pa.array(counts), pa.array([s.tobytes() for s in shapes]), pa.array(n)],
                    names=["id", "domain", "keys", "counts", "shapes", "n"],
                )
                at += len(n)

    rows = sample.mapInArrow(released(run), "id long, domain int, keys binary, counts binary, shapes binary, n long").collect()
    if not rows:
        return Classifier(weights)
    rows.sort(key=lambda r: (r.id, r.domain, r.n))
    y = np.array([r.domain for r in rows])
    keys = [np.frombuffer(r.keys, np.int32) for r in rows]
    size = np.array([len(k) for k in keys])
    own, flat = np.repeat(np.arange(len(rows)), size), np.concatenate(keys)
    value = np.concatenate([np.frombuffer(r.counts, np.float32) for r in rows]) / np.repeat(np.sqrt([max(r.n, 1) for r in rows]), size)
    shapes = np.array([np.frombuffer(r.shapes) for r in rows]).reshape(len(rows), SHAPES)
    target = np.eye(len(DOMAINS))[y]
    squares = np.full_like(weights, 1e-8)
    for _ in range(80):
        z = np.stack([np.bincount(own, value * weights[flat, k], len(rows)) for k in range(len(DOMAINS))], axis=1)
        error = (_softmax(z + shapes @ weights[1 << BUCKET_BITS : -1] + weights[-1]) - target) / len(rows)
        slope = np.concatenate(
            [
                np.stack([np.bincount(flat, value * error[own, k], 1 << BUCKET_BITS) for k in range(len(DOMAINS))], axis=1),
                shapes.T @ error,
                error.sum(axis=0, keepdims=True),
            ]
        ) + 1e-6 * weights
        squares += slope**2
        weights -= 0.2 * slope / np.sqrt(squares)
    return Classifier(weights)


def memberships(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of docs, n_tokens (words between white space) and shares: the domain posteriors of the whole text.

    Only the text goes to the workers, and nothing but its figures comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def figures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
            for bucket, first, n, shapes in _features(texts):
                sizes.append(n)
                shares.append(_softmax(_logits(shared.value, bucket, first, n, shapes)))
            flat = np.concatenate(shares)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(DOMAINS)), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), lists], names=["n_tokens", "shares"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(figures)(batches)

    # Not called deterministic, since a filter on its columns would otherwise run it a second time.
    told = F.arrow_udf(run, "n_tokens long, shares array<double>").asNondeterministic()
    return docs.select(*keep, told(F.col(text_col).cast("string")).alias("__told")).select(*keep, "__told.n_tokens", "__told.shares")


def _rate(turned: np.ndarray) -> Column:
    """Rate of a document after all steps, the turns of which add up to ``turned``."""
    turn = F.lit(0.0)
    for k, x in enumerate(turned):
        turn = turn + F.col("shares")[k] * F.lit(float(x))
    return F.greatest(F.lit(0.0), F.lit(1.0) - turn)


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS) -> tuple[np.ndarray, dict[str, float], float]:
    """The turn whose ``_rate`` makes the expected tokens per domain meet their targets, the totals reached, and the largest miss as
    a share of all tokens.

    Projected gradient for least squares over rates >= 0, started at 1, with lazy projection: steps against the gradient add up
    unprojected, and a document's rate is what they leave of 1, or 0. The gradient is, for every document, its shares times the miss of the
    totals, so the steps taken so far are one number per domain, and a document's rate follows from its shares in closed form. Steps are
    scaled by the domains' Gram matrix over the documents above 0. One pass over the documents sums rate * tokens * shares for several
    lengths of a step (a handful of numbers reach the driver); the length counts that brings the convex function whose gradient the
    miss is furthest down. Targets that no rates >= 0 can meet leave a miss: the fit then ends at the nearest totals, and the miss
    says so.
    """
    k = len(DOMAINS)
    share = [F.col("shares")[i] for i in range(k)]
    tokens = F.col("n_tokens").cast("double")

    def tried(turns: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
        """Totals, Gram matrix over the documents above 0 and half the squared rates after each turn, and all tokens."""
        rated = members.withColumns({f"r{j}": _rate(t) for j, t in enumerate(turns)})
        sums = [F.sum(tokens)]
        for j in range(len(turns)):
            rate = F.col(f"r{j}")
            free = F.when(rate > 0, tokens).otherwise(0.0)
            sums += [F.sum(rate * tokens * s) for s in share] + [F.sum(free * a * b) for a in share for b in share] + [F.sum(0.5 * rate * rate * tokens)]
        row = np.array([x or 0.0 for x in rated.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()])
        each = row[1:].reshape(len(turns), k + k * k + 1)
        return [(x[:k], x[k:-1].reshape(k, k), x[-1]) for x in each], row[0]

    turned = np.zeros(k)
    ((reached, gram, _),), total = tried([turned])
    goal, error = np.array([targets[d] for d in DOMAINS]) * total, []
    while True:
        miss = reached - goal
        off = float(np.abs(miss).max()) / max(total, 1.0)
        error.append(min([float(miss @ miss), *error[-1:]]))
        still = len(error) > PATIENCE and error[-1] >= (1 - STILL) * error[-1 - PATIENCE]
        if len(error) > steps or off <= TOLERANCE or still:
            return turned, dict(zip(DOMAINS, reached.tolist(), strict=True)), off
        ahead = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ miss
        turns = [turned + t * ahead for t in LENGTHS]
        results, _ = tried(turns)
        best = min(range(len(turns)), key=lambda j: results[j][2] + float(turns[j] @ goal))
        turned, (reached, gram, _) = turns[best], results[best]


def mixture(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """All columns of docs, and n_tokens, shares (posteriors of DOMAINS), rate (expected uses of the document, >= 0) and miss, the
    same in every row: by how much of all tokens the worst domain total misses its target.

    Every row is kept, with a rate of 0 where the mixture has no use for it. Null and empty texts have no tokens and the rate
    of their posterior; repeated rows get equal rates, null ids are no labelled rows. An empty input gives no rows. Columns of docs
    that are named like a new one are replaced.
    """
    classifier = fit_classifier(docs, labels, id_col, text_col)
    narrow = stored(memberships(docs, classifier, [], text_col))
    turned, _, miss = fit_rates(narrow, targets)
    keep = [c for c in docs.columns if c not in ("n_tokens", "shares", "rate", "miss")]
    return memberships(docs, classifier, keep, text_col).withColumns({"rate": _rate(turned), "miss": F.lit(float(miss))})
