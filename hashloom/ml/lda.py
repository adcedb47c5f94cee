"""Online variational Bayes for latent Dirichlet allocation on sets of words.

Topics x words parameters live on the driver as one matrix and are sent to the workers for a batch; documents are processed batch by
Arrow batch and give back sums per word. Memory is topics x words plus topics x documents of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.special import digamma, log_gamma

#: Cells of topics x words that are held by the driver, and twice by each worker (lambda and E[log beta], 160 MB each). Larger models are refused.
LIMIT = 20_000_000
#: Rounds of inference for one document; documents that stop there are counted.
CAP = 200


@dataclass
class LdaModel:
    lam: np.ndarray  # topics x words
    corpus_size: int
    alpha: float = 0.001
    eta: float = 0.001
    tau0: float = 256.0
    kappa: float = 0.5
    updates: int = 0
    unconverged: int = 0  # documents of the last ``learn`` whose inference ended at the cap

    @classmethod
    def start(cls, topics: int, words: int, corpus_size: int, seed: int = 0, even: bool = False, lam: np.ndarray | None = None, **how) -> LdaModel:
        """Random rows that sum to 1. ``even`` starts near 1 in every cell instead: words then choose their topics by document first.

        ``lam`` (topics x words) is a start of one's own.
        """
        if topics * words > LIMIT:
            raise ValueError(f"more than {LIMIT} cells of topics x words")
        if lam is not None:
            return cls(np.array(lam, dtype=float), corpus_size, **how)
        rng = np.random.default_rng(seed)
        if even:
            return cls(rng.gamma(100.0, 0.01, (topics, words)), corpus_size, **how)
        lam = rng.random((topics, words))
        return cls(lam / lam.sum(1, keepdims=True), corpus_size, **how)

    def rho(self) -> float:
        return (self.tau0 + self.updates) ** -self.kappa

    def log_beta(self) -> np.ndarray:
        """E[log beta], topics x words."""
        return digamma(self.lam) - digamma(self.lam.sum(1))[:, None]

    # kernels over one document

    def infer(self, words: np.ndarray, log_beta: np.ndarray, cap: int = CAP, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray, bool]:
        """(gamma, phi topics x words of the document, converged): iterated from gamma 1 until it changes by less than ``eps`` on average, at most ``cap`` times."""
        gamma = np.ones(len(self.lam))
        own = log_beta[:, words]
        phi = np.empty_like(own)
        for _ in range(cap):
            log_theta = digamma(gamma) - digamma(gamma.sum())
            phi = own + log_theta[:, None]
            phi = np.exp(phi - phi.max(0)) if len(words) else phi
            phi /= phi.sum(0) if len(words) else 1
            new = self.alpha + phi.sum(1)
            moved = np.abs(new - gamma).mean()
            gamma = new
            if moved < eps:
                return gamma, phi, True
        return gamma, phi, False

    def document_bound(self, words: np.ndarray, log_beta: np.ndarray, cap: int = CAP) -> float:
        gamma = self.infer(words, log_beta, cap)[0]
        log_theta = digamma(gamma) - digamma(gamma.sum())
        score = 0.0
        if len(words):
            p = log_beta[:, words] + log_theta[:, None]
            top = p.max(0)
            score = float((np.log(np.exp(p - top).sum(0)) + top).sum())
        k = len(gamma)
        score += float(((self.alpha - gamma) * log_theta).sum() + log_gamma(gamma).sum() - k * log_gamma(self.alpha))
        return score + float(log_gamma(self.alpha * k) - log_gamma(gamma.sum()))

    def model_bound(self) -> float:
        k, w = self.lam.shape
        score = ((self.eta - self.lam) * self.log_beta()).sum() + log_gamma(self.lam).sum() - k * w * log_gamma(self.eta)
        return float(score + k * log_gamma(self.eta * w) - log_gamma(self.lam.sum(1)).sum())

    # distributed passes

    def _over(self, vectors: DataFrame, each, schema: str) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((self, self.log_beta()))  # at most LIMIT cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, log_beta = shared.value
            for b in batches:
                docs = [np.asarray(x or (), dtype=np.int64) for x in b.column("col_ids").to_pylist()]
                yield from each(model, log_beta, b, docs)

        return vectors.select("row_id", "col_ids").mapInArrow(run, schema)

    def statistics(self, vectors: DataFrame, cap: int = CAP) -> DataFrame:
        """(col_id, stats ARRAY<DOUBLE>, n_docs, n_capped): phi summed up per word and Arrow batch; a row without col_id has the numbers of
        documents, those without words among them, and of those whose inference ended at the cap."""

        def each(model, log_beta, b, docs):
            phis, capped = [], 0
            for d in docs:
                _, phi, converged = model.infer(d, log_beta, cap)
                phis.append(phi.T)
                capped += not converged
            ids, inverse = np.unique(np.concatenate(docs) if docs else np.empty(0, np.int64), return_inverse=True)
            total = np.zeros((len(ids), len(model.lam)))
            if len(ids):
                np.add.at(total, inverse, np.concatenate(phis))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, len(model.lam)), pa.int32()), pa.array(total.ravel()))
            none = pa.array([None], pa.list_(pa.float64()))
            zeros = np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array([None], pa.int64()), pa.array(ids)]), pa.concat_arrays([none, stats]), pa.array(np.append([len(docs)], zeros)), pa.array(np.append([capped], zeros))],
                names=["col_id", "stats", "n_docs", "n_capped"],
            )

        return self._over(vectors, each, "col_id bigint, stats array<double>, n_docs bigint, n_capped bigint")

    def learn(self, vectors: DataFrame, cap: int = CAP) -> LdaModel:
        """One update from a batch of documents (row_id, col_ids): every word's lambda moves, also those not in the batch."""
        k = len(self.lam)
        sums = [F.sum(F.get("stats", i)).alias(f"s{i}") for i in range(k)]
        got = self.statistics(vectors, cap).groupBy("col_id").agg(F.sum("n_docs").alias("n"), F.sum("n_capped").alias("c"), *sums).toArrow()  # one row per word of the model
        known = got.filter(pc.is_valid(got["col_id"]))
        n = sum(got["n"].to_pylist())
        if not n:
            return self
        stats = np.zeros_like(self.lam)
        at = known["col_id"].to_numpy()
        for t in range(k):
            stats[t, at] = known[f"s{t}"].to_numpy()
        rho = self.rho()
        self.lam = (1 - rho) * self.lam + rho * (self.eta + self.corpus_size / n * stats)
        self.updates += 1
        self.unconverged = sum(got["c"].to_pylist())
        return self

    def document_topics(self, vectors: DataFrame, cap: int = CAP) -> DataFrame:
        """(row_id, gamma ARRAY<DOUBLE>, converged): converged is false where inference ended at the cap."""

        def each(model, log_beta, b, docs):
            g = [model.infer(d, log_beta, cap) for d in docs]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([x[0].tolist() for x in g], pa.list_(pa.float64())), pa.array([x[2] for x in g], pa.bool_())], names=["row_id", "gamma", "converged"])

        return self._over(vectors, each, f"row_id {vectors.schema['row_id'].dataType.simpleString()}, gamma array<double>, converged boolean")

    def bound(self, vectors: DataFrame, cap: int = CAP) -> float:
        """The evidence lower bound, the documents' part scaled to the corpus."""

        def each(model, log_beta, b, docs):
            yield pa.RecordBatch.from_arrays([pa.array([sum(model.document_bound(d, log_beta, cap) for d in docs)]), pa.array([len(docs)])], names=["s", "n"])

        r = self._over(vectors, each, "s double, n bigint").agg(F.sum("s"), F.sum("n")).first()
        return (r[0] * self.corpus_size / r[1] if r[1] else 0.0) + self.model_bound()

    def top_words(self, k: int) -> list[list[tuple[int, float]]]:
        """By topic: the k words with the largest share."""
        share = self.lam / self.lam.sum(1, keepdims=True)
        return [[(int(i), float(row[i])) for i in np.lexsort((np.arange(len(row)), -row))[:k]] for row in share]
