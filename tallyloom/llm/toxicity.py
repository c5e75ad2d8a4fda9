"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another: kinds of toxicity first, then
toxicity itself. Labels that tell only whether a text is toxic are divided into
kinds by short word lists (`KINDS`): a toxic text with a word of a kind's list is
an example of the kind, one without is left out of it, and what is not toxic is
a counter-example. Each category's linear model sees a
document's hashed words, the beginnings of longer ones, and the probabilities of
all earlier categories. Weights are kept sparse, so that a few telling words are
not drowned in a long text. In
training those come from out-of-fold predictions: every example's probability is
made by a model that has not seen it, so that a later model learns to trust an
earlier one no more than it deserves. A model fitted on all examples serves.

Scale. The chain is fitted on at most `train_docs` labelled documents, those whose
ids have the smallest hashes; only that bounded list of ids is broadcast to find
their texts, of which each id has one, and equal texts are one example. Scoring is a map over all documents, one text in memory at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, pick, rows
from .linear import WORD, Hasher, Linear, best_threshold, sigmoid

TRAIN_DOCS = 6_000
BUCKETS = 1 << 18
FOLDS = 5
#: Strength of the penalty that sets weights to zero.
SPARSITY = 4.0
#: Words in more than this share of the examples tell nothing, since a long text has all of them, unless one class has them ALIKE times as often as the other.
COMMON, ALIKE = 0.2, 3.0
#: Words in fewer examples than this get no weight.
RARE = 3
#: Words that tell kinds of toxicity, as beginnings of lower-cased words.
KINDS = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecil", "dumm", "idiota", "estupid", "tonto", "crétin"),
    "dehumanising": ("scum", "trash", "vermin", "filth", "garbage", "subhuman", "parasit", "abschaum", "müll", "basura", "escoria", "ordure"),
    "hostility": ("hate", "disgust", "pathetic", "worthless", "despicabl", "kill", "hass", "ekel", "odio", "asco", "haine", "dégoût"),
}


class Chain:
    """Fitted categories in order, each with its model and threshold. The first `kinds` of them don't tell which words are dull."""

    def __init__(self, names: list[str], index: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, folds: int = FOLDS, kinds: int = 0):
        self.names, self.buckets, self.models, self.thresholds = names, buckets, [], []
        dull = np.zeros(buckets, bool)
        if len(index):
            count = lambda at: np.bincount(np.concatenate([index[i] for i in at]) if len(at) else np.zeros(0, np.int64), minlength=buckets) / max(1, len(at))
            dull = count(np.arange(len(index))) > COMMON
            for j in range(kinds, len(names)):
                yes, no = count(np.flatnonzero(y[:, j] > 0.5)), count(np.flatnonzero(y[:, j] <= 0.5))
                dull &= (yes <= ALIKE * no) & (no <= ALIKE * yes)
            # Words of one or two examples can't be learned from; where examples are few, all are taken.
            dull |= np.bincount(np.concatenate(index), minlength=buckets) < min(RARE, 1 + len(index) // 100)
        index = [i[~dull[i]] for i in index]
        fold = np.arange(len(index)) % folds
        earlier = np.zeros((len(index), 0))
        for j in range(len(names)):
            known = ~np.isnan(y[:, j]) if len(index) else np.zeros(0, bool)
            out = np.zeros(len(index))
            for f in range(folds):
                learn, rest = np.flatnonzero((fold != f) & known), np.flatnonzero(fold == f)
                model = Linear(buckets, earlier.shape[1]).fit([index[i] for i in learn], earlier[learn], y[learn, j], l1=SPARSITY)
                out[rest] = [model.score(index[i], earlier[i]) for i in rest]
            every = np.flatnonzero(known)
            self.models.append(Linear(buckets, earlier.shape[1]).fit([index[i] for i in every], earlier[every], y[every, j], l1=SPARSITY))
            self.thresholds.append(best_threshold(out[every], y[every, j]))
            earlier = np.column_stack([earlier, out])
        #: Out-of-fold probabilities of the examples, for measuring.
        self.out_of_fold = earlier

    def predict(self, index: np.ndarray) -> list[float]:
        found: list[float] = []
        for model in self.models:
            found.append(float(sigmoid(model.margin(index, found))))
        return found


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, buckets: int = BUCKETS, folds: int = FOLDS, kinds: dict[str, tuple[str, ...]] | None = None, of: str | None = None) -> Chain:
    """A chain over categories, given as boolean expressions over labels, in order.

    `kinds` come before them in the chain: word lists that divide the examples of
    the category `of` (the last one unless told). Of labels that repeat an id, the
    largest value of each category counts; a null one leaves the example out of
    that category. Of rows that repeat an id, the text of smallest hash counts;
    of equal texts with several labels the largest. Ids without a document, or
    null, are not used. Without any label every probability is 0.5. Ids are integers.
    """
    names, kinds = list(categories), kinds or {}
    columns = [f"c{i}" for i in range(len(names))]
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[e.cast("double").alias(c) for c, e in zip(columns, categories.values(), strict=True)])
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(train_docs)
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id")
    # One text for each id, on the map side first; the few texts that are left are spread over tasks again.
    one = texts.groupBy("doc_id", *columns).agg(F.min(F.struct(F.xxhash64("text").alias("same"), "text")).alias("t"))
    one = one.select("doc_id", *columns, "t.same", "t.text").repartition(16, "doc_id")

    def example(batches):
        import pyarrow as pa

        hasher = Hasher(buckets)
        schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), *[(c, pa.float64()) for c in columns], ("told", pa.list_(pa.bool_())), ("index", pa.list_(pa.int64()))])
        yield from in_batches(schema, ((*x[:-1], [tells(x[-1], k) for k in kinds.values()], hasher.starts(x[-1])) for x in rows(batches, "doc_id", "same", *columns, "text")), 500)

    kind = f"doc_id long, same long, {', '.join(f'{c} double' for c in columns)}, told array<boolean>, index array<long>"
    pdf = one.mapInArrow(example, kind).toPandas()
    pdf = pdf.groupby("same", as_index=False).agg({"doc_id": "min", **dict.fromkeys(columns, "max"), "told": "first", "index": "first"})
    pdf = pdf.assign(turn=[(int(d) * 2654435761) % (1 << 32) for d in pdf["doc_id"]]).sort_values(["turn", "doc_id"], kind="stable")
    y = pdf[columns].to_numpy(float)
    whole = y[:, names.index(of or names[-1])] if len(names) else np.zeros(len(y))
    told = np.array([np.asarray(x, bool) for x in pdf["told"]], bool).reshape(len(pdf), len(kinds))
    divided = np.where(whole[:, None] > 0.5, np.where(told, 1.0, np.nan), whole[:, None])
    return Chain([*kinds, *names], [np.asarray(x, np.int64) for x in pdf["index"]], np.hstack([divided, y]), buckets, folds, len(kinds))


def tells(text: str | None, beginnings: tuple[str, ...]) -> bool:
    """Whether a word of the text begins like one of these."""
    return any(w.startswith(beginnings) for w in WORD.findall((text or "").lower()))


def scored(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>, is_<category>, ...) for every row of docs, in the chain's order.

    A null text counts as empty and gets the models' bias. Repeated rows are
    kept and score alike. An empty table gives no rows. Ids are integers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = list(chain.names)

    def run(batches):
        import pyarrow as pa

        model, hasher = sent.value, Hasher(sent.value.buckets)
        schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in names], *[(f"is_{c}", pa.bool_()) for c in names]])

        def items():
            for d, t in rows(batches, "doc_id", "text"):
                p = model.predict(hasher.starts(t))
                yield (d, *p, *[x >= least for x, least in zip(p, model.thresholds, strict=True)])

        yield from in_batches(schema, items(), 20_000)

    slim = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = [f"p_{c} double" for c in names] + [f"is_{c} boolean" for c in names]
    return slim.mapInArrow(run, f"doc_id long, {', '.join(kinds)}")
