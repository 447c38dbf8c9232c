"""Language identification by hierarchical discrimination (operator 2).

Features are hashed counts of letter uni-, bi- and trigrams of the whole text, square-rooted and scaled to
length one.  Languages whose mean vectors lie close together form a family (average-linkage clustering
of the centroids, cut at the mean similarity).  A prediction first picks the family (one linear support vector
machine for each, largest margin), then lets one-versus-one linear support vector machines between
the languages of that family vote.  The machines are trained here by dual coordinate descent.

Training takes at most ``per_language`` labelled rows of each language and ``SAMPLE_ROWS`` of all, those of smallest id hash (a
bounded sample, as documented); only their feature vectors reach the driver (at most 128 MB), never texts.  A family holds
at most ``MOST_IN_FAMILY`` languages, so that the model, which is broadcast, has at most eight pairs for each language.  Prediction goes over
all texts, in Arrow batches; a long text is read in pieces, which give the very counts of the whole.

Defined cases: null text or text without a letter is ``und`` with score 0; without any labelled row all
is ``und``; with one language that one wins with score 1; null doc_id is neither trained on nor held out; repeated rows are predicted each, and of
those in the sample each counts; equal votes are settled by the margins, then by name; an empty table gives an empty result; extra columns pass
through, a column named like an output (lang_pred, score, in any case) is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runstore.llm.common import map_texts

DIMS = 4096
PER_LANGUAGE, SAMPLE_ROWS = 250, 8192
MOST_IN_FAMILY = 16
CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the text's letter n-grams; None without a letter."""
    if not text:
        return None
    counts, table, any_letter = np.zeros(DIMS, np.int64), letter_table(), False
    text = f" {text.lower()} "
    for lo in range(0, len(text), CHUNK):
        # two characters more for the n-grams that begin in this piece; beyond the end there are none
        cp = np.frombuffer(text[lo : lo + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = table[cp]
        any_letter = any_letter or bool(is_letter.any())
        c = np.where(is_letter, cp, 32).astype(np.uint32)
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for grams, real in ((one, c != 32), (two, (c[:-1] != 32) | (c[1:] != 32)), (three, c[1:-1] != 32)):
            counts += np.bincount(grams[:CHUNK][real[:CHUNK]] >> np.uint32(20), minlength=DIMS)
    if not any_letter:
        return None
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of an L2-loss linear support vector machine, by dual coordinate descent; y is +1 or -1."""
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}  # classes weigh alike
    diag = np.array([1 / (2 * cost * share[s]) for s in y])
    norm = (x * x).sum(axis=1) + diag
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(w @ x[i]) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def families(centroids: np.ndarray) -> list[list[int]]:
    """Average-linkage clusters of the languages, cut at the mean similarity of all pairs."""
    n = len(centroids)
    unit = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)
    sim = unit @ unit.T
    groups = [[i] for i in range(n)]
    if n < 3:
        return groups
    cut = sim[np.triu_indices(n, 1)].mean()
    while len(groups) > 2:
        near = [(sim[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j and len(p) + len(q) <= MOST_IN_FAMILY]
        best, a, b = max(near, default=(cut - 1, 0, 0))
        if best < cut:
            break
        groups[a] += groups.pop(b)
    return groups


class Model:
    def __init__(self, x: np.ndarray, names: list[str]):
        self.names = sorted(set(names))
        y = np.array([self.names.index(n) for n in names], np.int64)
        centroids = np.stack([x[y == k].mean(axis=0) for k in range(len(self.names))]) if self.names else np.zeros((0, DIMS))
        self.families = [sorted(g) for g in families(centroids)]
        of = np.array([next(f for f, g in enumerate(self.families) if k in g) for k in range(len(self.names))])
        fam = of[y] if len(y) else y
        many = len(self.families) > 1
        self.top = np.stack([linear_svm(x, np.where(fam == f, 1, -1)) for f in range(len(self.families))]) if many else None
        self.pairs = {}
        for group in self.families:
            for i, a in enumerate(group):
                for b in group[i + 1 :]:
                    own = (y == a) | (y == b)
                    self.pairs[a, b] = linear_svm(x[own], np.where(y[own] == a, 1, -1))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language and a score: the family's share of the softened margins times the votes' mean strength."""
        if not self.names:
            return "und", 0.0
        family, score = 0, 1.0
        if self.top is not None:
            margin = self.top @ v
            family = int(margin.argmax())
            e = np.exp(4 * (margin - margin.max()))
            score = float(e[family] / e.sum())
        group = self.families[family]
        if len(group) == 1:
            return self.names[group[0]], score
        votes, strength = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0)
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                p = 1 / (1 + np.exp(-4 * float(self.pairs[a, b] @ v)))
                votes[a if p >= 0.5 else b] += 1
                strength[a] += p
                strength[b] += 1 - p
        best = max(group, key=lambda k: (votes[k], strength[k], -k))
        return self.names[best], min(1.0, score * float(strength[best]) / (len(group) - 1))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of at most ``per_language`` rows of each language and SAMPLE_ROWS in all."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # one for each class
    if not sizes:
        return Model(np.zeros((0, DIMS), np.float32), [])
    per_language = max(1, min(per_language, SAMPLE_ROWS // len(sizes)))
    # thin out by id hash first, so that ranking sees a few hundred rows of a language and not all
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, (2 * per_language + 50) / n)))])
    h = F.xxhash64(F.col(key), F.lit("language sample"))
    thin = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    few = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language).drop("r", "h")

    def start():
        def work(texts):
            return {"x": [None if (v := features(t)) is None else v.tobytes() for t in texts]}

        return work

    got = map_texts(few, "text", T.StructType([T.StructField("x", T.BinaryType())]), start).where("x is not null").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    if not got:
        return Model(np.zeros((0, DIMS), np.float32), [])
    return Model(np.stack([np.frombuffer(v, np.float32) for _, v in got]), [n for n, _ in got])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, plus lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    outputs = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def start():
        own = sent.value

        def work(texts):
            made = [("und", 0.0) if (v := features(t)) is None else own.predict(v) for t in texts]
            return {"lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

        return work

    return map_texts(docs, text, outputs, start)
