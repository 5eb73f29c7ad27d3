"""Records of several sources mixed to target shares.

A classifier trained on a bounded sample of the labelled rows gives every record its posterior over
the sources: naive Bayes over hashed tokens, whose scores, with the text's length and surface signs,
go through a softmax regression fitted on other rows, so that posteriors are calibrated and fall back
on the sources' shares where the text tells nothing.  A labelled record belongs to its source, the
posterior decides for the others.  Projected gradient steps on a least-squares objective fit a
non-negative rate for each record, at most its source's cap, so that the expected tokens of each
source meet the targets.  Rates become whole numbers of uses with the rounding errors of a source
passed on from record to record within a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import TOKENIZER, encoder
from millrace.session import cut_lineage

#: Labelled rows that the classifier is trained on, at most about; all sources that occur are in it in proportion.
TRAIN_ROWS = 20_000
#: Of 10 parts of these rows: so many for the token tables, so many for the regression; the rest is held out.
TABLE_PARTS, FIT_PARTS = 6, 3
#: How much the regression may be shrunk towards the sources' shares.
SHRINK = (0.003, 0.03, 0.3)
#: Hashed token features of the classifier.
FEATURES = 4096
#: Steps end when the tokens of every source that could still move are this near to what is wanted, as a share of all, or move by less than a quarter of it.
TOLERANCE = 1e-4
#: Targets and sources are collected; there may be no more than this.
MAX_SOURCES = 1000


def _ids(text: str | None, path: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    try:
        return np.asarray(encoder(path).encode_ordinary(text), np.int64)
    except UnicodeEncodeError:
        return np.asarray(encoder(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")), np.int64)


#: Bytes that are counted together as one surface sign.
_SIGNS = (b"\r", b"<", b"[(", b"#*", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b":", b"?!", b"@/", b"|", bytes(range(128, 256)))
_SIGN_TABLE = np.array([[b in some for some in _SIGNS] for b in range(256)], float)


def _surface(text: str | None, n_tokens: int) -> np.ndarray:
    """Length and shares of surface signs of a text, on a scale of logarithms."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _SIGN_TABLE
    before, after = raw[:-1], raw[1:]
    capital = (after >= 65) & (after <= 90)
    # capitals within words, and after signs that are read for letters
    within = (capital & (before >= 97) & (before <= 122)).sum()
    mixed = (capital & ((before == 108) | (before == 124) | ((before >= 48) & (before <= 57)))).sum()
    return np.concatenate([[np.log1p(n_tokens)], np.log1p(100.0 * np.append(shares, [within, mixed]) / (len(raw) + 1))])


@dataclass
class Classifier:
    """Naive Bayes scores of hashed tokens and surface signs, weighed by a softmax regression."""

    sources: list[str]
    log_prior: np.ndarray
    #: A row a feature, a column a source.
    log_likelihood: np.ndarray
    #: The regression's weights, a column a source, and what its inputs are shifted and scaled by (None: posteriors are the prior).
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    #: ``rows, accuracy, majority, log_loss, prior_log_loss, calibration_error`` on held-out labelled rows.
    report: dict[str, float] = field(default_factory=dict)

    def inputs(self, texts: list[str | None], ids: list[np.ndarray]) -> np.ndarray:
        """What the regression gets of each text and its tokens, a row a text."""
        out = [np.zeros((0, len(self.sources) + len(_SIGNS) + 3))]
        for lo in range(0, len(texts), 256):
            part = ids[lo : lo + 256]
            sizes = np.array([len(x) for x in part])
            score = np.zeros((len(part), len(self.sources)))
            if sizes.any():
                filled = np.flatnonzero(sizes)
                each = self.log_likelihood[np.concatenate(part) % FEATURES]
                score[filled] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[filled], axis=0) / np.sqrt(sizes[filled])[:, None]
            surface = [_surface(t, int(n)) for t, n in zip(texts[lo : lo + 256], sizes, strict=True)]
            out.append(np.hstack([score - score.mean(axis=1, keepdims=True), surface]))
        return np.vstack(out)

    def posteriors(self, inputs: np.ndarray) -> np.ndarray:
        """A row a record."""
        score = np.tile(self.log_prior, (len(inputs), 1))
        if self.weights is not None:
            score = score + _with_one((inputs - self.center) / self.scale) @ self.weights
        return np.exp(_log_softmax(score))

    def fit(self, inputs: np.ndarray, labels: np.ndarray) -> None:
        """Fits the regression, as much shrunk towards the prior as does best on the half of the rows that it isn't fitted on; the prior stays where none does better."""
        self.center, self.scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-6
        x = _with_one((inputs - self.center) / self.scale)
        halves = np.arange(len(x)) % 2
        best, chosen = -np.log(np.maximum(np.exp(self.log_prior)[labels], 1e-12)).sum(), None
        for shrink in SHRINK:
            loss = 0.0
            for h in (0, 1):
                weights = self._descend(x[halves != h], labels[halves != h], shrink)
                loss -= _log_softmax(self.log_prior + x[halves == h] @ weights)[np.arange((halves == h).sum()), labels[halves == h]].sum()
            if loss < best:
                best, chosen = loss, shrink
        self.weights = None if chosen is None else self._descend(x, labels, chosen)

    def _descend(self, x: np.ndarray, labels: np.ndarray, shrink: float, steps: int = 100) -> np.ndarray:
        """Accelerated gradient steps on the log loss."""
        wanted = np.eye(len(self.sources))[labels]
        w = ahead = np.zeros((x.shape[1], len(self.sources)))
        if not len(x):
            return w
        rate = 1.0 / (0.5 * float(np.linalg.norm(x, 2)) ** 2 / len(x) + shrink)
        for k in range(steps):
            slope = x.T @ (np.exp(_log_softmax(self.log_prior + x @ ahead)) - wanted) / len(x)
            new = ahead - rate * (slope + shrink * ahead)
            ahead = new + k / (k + 3) * (new - w)
            w = new
        return w

    def judge(self, inputs: np.ndarray, labels: np.ndarray) -> None:
        p = self.posteriors(inputs)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        right = best == labels
        bins = np.minimum((sure * 10).astype(int), 9)
        gaps = sum(abs(right[bins == b].sum() - sure[bins == b].sum()) for b in range(10)) / len(p)
        loss = lambda q: float(-np.log(np.maximum(q, 1e-12)).mean())
        self.report = {
            "rows": float(len(p)), "accuracy": float(right.mean()), "majority": float((labels == self.log_prior.argmax()).mean()),
            "log_loss": loss(p[np.arange(len(p)), labels]), "prior_log_loss": loss(np.exp(self.log_prior)[labels]), "calibration_error": float(gaps),
        }


def _log_softmax(score: np.ndarray) -> np.ndarray:
    score = score - score.max(axis=1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def train(documents: DataFrame, text: str, source: str, path: str = TOKENIZER, rows: int = TRAIN_ROWS) -> Classifier:
    """Trains on about ``rows`` labelled rows, chosen by a hash of the text; on all where there are fewer.

    The token tables are counted where the rows lie; of the rows for the regression and the held-out
    ones the driver gets a few dozen numbers each.
    """
    labelled = documents.where(F.col(source).isNotNull())
    counts = labelled.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(r.s for r in counts)
    at = {s: i for i, s in enumerate(sources)}
    total = sum(r.n for r in counts)
    parts = 1 << 20
    share = parts if total <= rows else parts * rows // total
    chosen = labelled.where(F.pmod(F.xxhash64(text, F.length(text)), F.lit(parts)) < share)
    part = F.pmod(F.xxhash64(F.lit("part"), text), F.lit(10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.setdefault(s, np.zeros(FEATURES))
                table[s] += np.bincount(_ids(t, path) % FEATURES, minlength=FEATURES)
        for s, counted in table.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([counted], pa.list_(pa.float64()))], names=["s", "c"])

    partial = chosen.where(part < TABLE_PARTS).select(F.col(source).cast("string"), text).mapInArrow(run, "s string, c array<double>")
    # arrays of fixed length are added position by position, a row a source and feature
    summed = partial.select("s", F.posexplode("c").alias("i", "v")).where("v > 0").groupBy("s", "i").agg(F.sum("v").alias("v")).toPandas()
    table = np.zeros((len(sources), FEATURES))
    table[[at[s] for s in summed["s"]], summed["i"].to_numpy(np.int64)] = summed["v"].to_numpy()
    # a source of few rows is smoothed towards what all have in common
    common = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * FEATURES)
    smooth = table + 0.2 * FEATURES * common
    prior = np.array([next(r.n for r in counts if r.s == s) for s in sources], float)
    model = Classifier(sources, np.log(prior / prior.sum()) if total else prior, np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T, np.float32))
    if len(sources) < 2:
        return model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = shared.value.inputs(texts, [_ids(t, path) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(got), pa.list_(pa.float64()))], names=["s", "part", "x"])

    rest = chosen.where(part >= TABLE_PARTS).select(F.col(source).cast("string"), text, part.alias("part"))
    seen = rest.mapInArrow(look, "s string, part bigint, x array<double>").toPandas()  # at most about ``rows`` rows
    seen = seen.assign(k=[str(x) for x in seen["x"]]).sort_values(["part", "s", "k"]) if len(seen) else seen
    fit, held = seen[seen["part"] < TABLE_PARTS + FIT_PARTS], seen[seen["part"] >= TABLE_PARTS + FIT_PARTS]
    if len(fit):
        model.fit(np.vstack(list(fit["x"])), fit["s"].map(at).to_numpy(np.int64))
    if len(held):
        model.judge(np.vstack(list(held["x"])), held["s"].map(at).to_numpy(np.int64))
    return model


def sized(documents: DataFrame, doc_id: str, text: str, source: str, model: Classifier, path: str = TOKENIZER) -> DataFrame:
    """``id, source, n_tokens, posterior``: every record's posterior over model.sources (null where there are none)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # sources x FEATURES numbers
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids = [_ids(t, path) for t in texts]
            soft = list(model.posteriors(model.inputs(texts, ids))) if model.sources else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(soft if soft is not None else [None] * len(ids), pa.list_(pa.float64()))],
                names=["id", "source", "n_tokens", "posterior"],
            )

    rows = documents.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), text)
    return rows.mapInArrow(run, f"id {kind}, source string, n_tokens bigint, posterior array<double>")


def feasible_targets(target: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The nearest shares that sources with records can have: what absent ones would get is spread evenly."""
    target = target / target.sum() if target.sum() > 0 else target
    out = np.where(present, target, 0.0)
    open_ = present & (target > 0)
    if open_.any():
        out[open_] += (1.0 - out.sum()) / open_.sum()
    return out


class _Problem:
    """The objective's fixed part, as shipped to the workers: domains, their caps and the steps taken so far."""

    def __init__(self, sources: list[str], domains: list[str], cap: np.ndarray):
        self.domains, self.cap = domains, cap
        self.at = {d: i for i, d in enumerate(domains)}
        self.columns = np.array([self.at[s] for s in sources], np.int64)
        self.steps: list[np.ndarray] = []

    def memberships(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """A row of memberships for each record, and its cap (for a soft member the expected one, rounded down)."""
        member = np.zeros((len(pdf), len(self.domains)))
        home = pdf["source"].map(self.at)
        known = np.flatnonzero(home.notna())
        member[known, home.iloc[known].astype(np.int64)] = 1.0
        soft = np.flatnonzero((home.isna() & pdf["posterior"].notna()).to_numpy())
        if len(soft):
            member[np.ix_(soft, self.columns)] = np.vstack(list(pdf["posterior"].iloc[soft]))
        return member, np.floor(member @ self.cap + 1e-9)

    def rates(self, member: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """The rates after all steps: each is a gradient step in the metric of the domains' sizes, projected on [0, cap]."""
        rate = np.zeros(len(member))
        for step in self.steps:
            rate = np.clip(rate - member @ step, 0.0, cap)
        return rate


def mix(
    documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, path: str = TOKENIZER, total: float | None = None, iterations: int = 100, model: Classifier | None = None
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) for the targets ``source, target_share, max_repeats``.

    selection: ``<doc_id>, source, n_tokens, times``, one row a record used, times at most its source's
    max_repeats (of an unlabelled record: what it may expect by its posterior, rounded down).  shares:
    ``source, target_share, feasible_share, expected_share, labelled_share, posterior_share, n_docs,
    n_uses, n_tokens, most_times, n_steps, converged``: expected_share counts labelled tokens and the
    soft mass of unlabelled ones, labelled_share the first alone, posterior_share what the classifier
    would say of all that is selected.  converged says whether the steps ended because no source that
    could still move was off by more than TOLERANCE, or none moved any more.

    ``total`` is the number of tokens wanted; by default the most with which every source that has
    records can meet its share.  Sources without a target, and records without tokens, are used 0
    times; a target without records is spread over the others; no records at all give an empty
    selection.  A target row with a null source, share or cap counts as 0.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    model = model or train(documents, text, source, path)
    domains = sorted({*model.sources, *(r.source for r in wanted)})
    at = {d: i for i, d in enumerate(domains)}
    target, cap = np.zeros(len(domains)), np.zeros(len(domains))
    for r in wanted:
        target[at[r.source]] = r.target_share or 0.0
        cap[at[r.source]] = r.max_repeats or 0
    table = cut_lineage(sized(documents, doc_id, text, source, model, path))  # ids and sizes only
    problem = _Problem(model.sources, domains, cap)
    # all labelled records of a source have one rate: for the steps its tokens are enough; only the others are read at each step
    known = np.zeros(len(domains))
    for r in table.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
        known[at[r.source]] = r.n
    unlabelled = table.where(F.col("source").isNull()).select("source", "n_tokens", "posterior")
    unlabelled = cut_lineage(unlabelled)
    whole = pd.DataFrame({"source": domains, "posterior": None})

    def sums(problem: _Problem, available: bool) -> np.ndarray:
        """Tokens of each domain at the present rates (``available``: at the caps)."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(len(problem.domains))
            for pdf in frames:
                member, most = problem.memberships(pdf)
                rate = most if available else problem.rates(member, most)
                acc += (rate * pdf["n_tokens"].to_numpy(float)) @ member
            yield pd.DataFrame({"d": range(len(acc)), "v": acc})

        member, most = problem.memberships(whole)
        out = known * (most if available else problem.rates(member, most))
        for r in unlabelled.mapInPandas(run, "d int, v double").groupBy("d").agg(F.sum("v").alias("v")).collect():
            out[r.d] += r.v
        return out

    room = sums(problem, True)  # tokens of each domain if every record is used as often as it may be
    goal = feasible_targets(target, (room > 0) & (target > 0))
    wished = goal > 0
    size = total if total is not None else (float((room[wished] / goal[wished]).min()) if wished.any() else 0.0)
    metric = np.where(room > 0, room / np.maximum(cap, 1), 1.0)
    near = TOLERANCE * min(size, float(room.sum()))
    converged, used, before = size <= 0, np.zeros(len(domains)), None
    for _ in range(iterations if size > 0 else 0):
        residual = used - size * goal
        stuck = np.where(residual > 0, used <= 0, used >= room - near)
        still = before is not None and np.abs(used - before).max() <= near / 4
        if still or np.abs(np.where(stuck, 0.0, residual)).max() <= near:
            converged = True
            break
        before = used
        problem.steps.append(residual / metric)
        used = sums(problem, False)

    def whole_uses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # each partition begins with another part of a record owed, so that rounding favours no source over many partitions
        part_id = TaskContext.get().partitionId()
        start = np.array([zlib.crc32(f"{part_id} {d}".encode()) / 2**32 - 0.5 for d in problem.domains])
        debt, fresh = np.zeros(len(domains)), np.ones(len(domains), bool)
        for pdf in frames:
            member, most = problem.memberships(pdf)
            rate = problem.rates(member, most)
            tokens = pdf["n_tokens"].to_numpy(float)
            uses = np.floor(rate + 1e-9)
            part = np.clip(rate - uses, 0.0, 1.0) * (tokens > 0)
            home = member.argmax(axis=1) if len(domains) else np.zeros(len(pdf), int)
            for i in np.flatnonzero(part > 1e-9):
                h = home[i]
                if fresh[h]:
                    debt[h], fresh[h] = start[h] * tokens[i], False
                debt[h] += part[i] * tokens[i]
                if debt[h] >= tokens[i] / 2:
                    uses[i] += 1
                    debt[h] -= tokens[i]
            out = pdf[["id", "source", "n_tokens", "posterior"]].copy()
            out["times"] = np.where(tokens > 0, uses, 0).astype(np.int64)
            out["soft"] = list(member)
            yield out[out["times"] > 0]

    kind = dict(table.dtypes)["id"]
    used_rows = table.mapInPandas(whole_uses, f"id {kind}, source string, n_tokens bigint, posterior array<double>, times bigint, soft array<double>")
    selection = used_rows.select(F.col("id").alias(doc_id), "source", "n_tokens", "times")
    rows = [(d, float(target[i]), float(goal[i]), i + 1) for d, i in at.items()]
    frame = spark.createDataFrame(rows, "source string, target_share double, feasible_share double, i int")
    weight = F.col("times") * F.col("n_tokens")

    def by_place(values: str, name: str) -> DataFrame:
        return used_rows.select(F.posexplode(values).alias("p", "m"), weight.alias("w")).groupBy("p").agg(F.sum(F.col("m") * F.col("w")).alias(name))

    expected = by_place("soft", "e").select((F.col("p") + 1).alias("i"), "e")
    names = spark.createDataFrame(list(enumerate(model.sources)), "p int, source string")
    told = by_place("posterior", "q").join(names, "p").select("source", "q")
    hard = used_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("times").alias("n_uses"), F.sum(weight).alias("n_tokens"), F.max("times").alias("most_times"))
    joined = frame.join(expected, "i", "left").join(hard, "source", "left").join(told, "source", "left")
    every = F.sum("e").over(Window.partitionBy(F.lit(1)))  # over a row a source
    share = {n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / every for n, c in (("expected_share", "e"), ("labelled_share", "n_tokens"), ("posterior_share", "q"))}
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_docs", "n_uses", "n_tokens", "most_times")}
    shares = joined.withColumns(share).withColumns(counts).withColumns({"n_steps": F.lit(len(problem.steps)), "converged": F.lit(bool(converged))})
    return selection, shares.select("source", "target_share", "feasible_share", "expected_share", "labelled_share", "posterior_share", *counts, "n_steps", "converged")
