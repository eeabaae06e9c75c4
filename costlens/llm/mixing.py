"""Mixing by soft membership: document rates whose expected domain totals match targets."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from costlens.llm import terms
from costlens.llm.encode import sliced
from costlens.llm.tables import only, prepare, stage

LOG = logging.getLogger(__name__)
#: Bounds of the classifier's sample, vocabulary and classes.
EXAMPLES, VOCABULARY, DOMAINS = 4096, 2048, 64
DENSE = 6


def shape(words: terms.Words, texts: pa.Array) -> np.ndarray:
    """Dense features: length, distinct share, top word's share, marks, capitals, digits."""
    n = np.maximum(words.total, 1)
    distinct = np.bincount(words.row, minlength=words.rows)
    top = np.zeros(words.rows)
    np.maximum.at(top, words.row, words.count)
    out = [np.log1p(words.total) / 10, distinct / n, top / n]
    for pattern in ("[!#*$%&|<>]", r"\p{Lu}", "[0-9]"):
        hits = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        out.append(np.minimum(hits / n, 5.0))
    return np.stack(out, axis=1)


class Classifier:
    """Softmax regression over term presence and dense features."""

    def __init__(self, domains: list[str], vocabulary: list[str], weight: np.ndarray):
        self.domains, self.vocabulary, self.weight = domains, vocabulary, weight

    def posterior(self, rows: int, row: np.ndarray, term: np.ndarray, dense: np.ndarray) -> np.ndarray:
        size = len(self.vocabulary)
        z = dense @ self.weight[size:-1] + self.weight[-1]
        if len(row):
            np.add.at(z, row, self.weight[term])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def softmax_fit(rows: int, row, term, dense, label, weight, size: int, classes: int,
                steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights by accelerated gradient descent on the weighted log loss."""
    w = np.zeros((size + dense.shape[1] + 1, classes))
    look, rate = w.copy(), 4.0 / (4 + np.bincount(row, minlength=rows).mean() if rows else 4)
    hot = np.eye(classes)[label]
    weight = weight / weight.sum()
    model = Classifier([], [""] * size, look)
    for step in range(steps):
        model.weight = look
        g = (model.posterior(rows, row, term, dense) - hot) * weight[:, None]
        grad = np.zeros_like(w)
        np.add.at(grad, term, g[row])
        grad[size:-1], grad[-1] = dense.T @ g, g.sum(axis=0)
        new = look - rate * (grad + ridge * look)
        look = new + step / (step + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labelled: DataFrame, domain: str = "domain",
        per_class: int = EXAMPLES, limit: int = VOCABULARY) -> Classifier:
    """A classifier from about `per_class` rows of each domain of `labelled`.

    `labelled` has doc_id and a domain name; null names take no part, and of several
    names of a document the smallest counts. No labelled rows: one domain, "all".
    """
    prepare(docs.sparkSession)
    named = (labelled.where(F.col(domain).isNotNull()).groupBy("doc_id")
             .agg(F.min(domain).alias("y")))
    chosen, full = terms.examples(docs, named, "y", per_class)
    sizes = terms.class_sizes(chosen, "y")
    domains = sorted(sizes)
    if len(domains) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    if len(domains) < 2:
        return Classifier(domains or ["all"], [], np.zeros((DENSE + 1, 1)))
    vocab = terms.vocabulary(chosen, "y", sizes, limit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = terms.Counter(vocab)
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            words = terms.Words(batch.column("text"))
            row, term, _ = counter.count(words)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            dense = shape(words, batch.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("h"),
                 pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                 pa.array(list(dense), pa.list_(pa.float64()))], ["y", "h", "term", "dense"])

    found = list(chosen.select("y", "text", F.xxhash64("text").alias("h")).mapInArrow(
        scan, "y string, h long, term array<int>, dense array<double>").toLocalIterator())
    found.sort(key=lambda r: (r["h"], r["y"]))
    row = np.repeat(np.arange(len(found)), [len(r["term"]) for r in found]).astype(np.int64)
    term = np.array([t for r in found for t in r["term"]], np.int64)
    label = np.array([domains.index(r["y"]) for r in found])
    weight = np.array([full[r["y"]] / sizes[r["y"]] for r in found])
    dense = np.array([r["dense"] for r in found])
    return Classifier(domains, vocab, softmax_fit(
        len(found), row, term, dense, label, weight, len(vocab), len(domains)))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, rid, n_tokens, p): words and domain posteriors of every row, staged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        counter = terms.Counter(m.vocabulary)
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            words = terms.Words(batch.column("text"))
            row, term, _ = counter.count(words)
            p = m.posterior(batch.num_rows, row, term,
                            shape(words, batch.column("text").fill_null("")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.total, pa.int64()),
                 pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return stage(rows.mapInArrow(scan, f"doc_id {kind}, n_tokens long, p array<double>"),
                 "memberships")


def rates_of(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: each is a gradient step, then the cut at zero."""
    r = np.ones(len(p))
    for step in history:
        r = np.maximum(r - p @ step, 0)
    return r


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False)
    return p.reshape(batch.num_rows, -1)


def totals(members: DataFrame, size: int, history: list[np.ndarray]) -> tuple[
        np.ndarray, np.ndarray, float]:
    """Expected tokens per domain at the current rates, sum of n p p' over rows whose rate
    is above zero, and tokens per row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size + 2)
        for batch in batches:
            if batch.num_rows:
                p, n = _matrix(batch), batch.column("n_tokens").to_numpy()
                rate = rates_of(p, history)
                total[:size] += (n * rate) @ p
                total[size:-2] += ((p * (n * (rate > 0))[:, None]).T @ p).ravel()
                total[-2:] += n.sum(), len(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"])
    sums = members.select("n_tokens", "p").mapInArrow(scan, "at int, value double").groupBy(
        "at").agg(F.sum("value").alias("value"))
    out = np.zeros(size + size * size + 2)
    for r in sums.toLocalIterator():
        out[r["at"]] = r["value"]
    return out[:size], out[size:-2].reshape(size, size), out[-2] / max(1.0, out[-1])


def solve(members: DataFrame, targets: np.ndarray, steps: int = 60,
          tolerance: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of projected gradient descent on the targets' squared relative errors,
    and what the totals still lack or have too much.

    The unknowns are one rate per document; the metric weighs documents by their
    tokens, so that a step moves a rate by its posteriors only. A task folds the
    known steps over its rows and returns one number per domain: nothing per
    document is stored or sent between steps. A step is scaled by the moments of the
    rows that can still move; if that does not lower the errors, the plain gradient
    step follows, which cannot raise them. It ends when every domain is within
    `tolerance` of its own target (or one document's tokens), or no step lowers the
    errors by a thousandth.
    """
    size, history = len(targets), []
    scale = np.sqrt(np.maximum(targets, 1.0))
    done, gram, row = totals(members, size, history)
    top = np.linalg.eigvalsh(gram / np.outer(scale, scale)).max(initial=0.0)
    near = np.minimum(np.maximum(tolerance * targets, row), tolerance * max(1.0, targets.sum()))
    while len(history) < steps and top > 0 and (np.abs(done - targets) > near).any():
        gap = done - targets
        error = np.square(gap / scale).sum()
        scaled = np.linalg.lstsq(gram / np.outer(scale, scale), gap / scale, 1e-9)[0] / scale
        for step in (scaled, gap / scale ** 2 / top):
            after, moved, _ = totals(members, size, [*history, step])
            if np.square((after - targets) / scale).sum() < 0.999 * error:
                break
        else:
            break
        history, done, gram = [*history, step], after, moved
    return history, np.where(np.abs(done - targets) > near, done - targets, 0.0)


def plan(docs: DataFrame, model: Classifier, shares: dict[str, float], of: str,
         steps: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Staged memberships and the steps that bring their totals to the targets."""
    prepare(docs.sparkSession)
    members = memberships(docs, model)
    held, _, _ = totals(members, len(model.domains), [])
    targets = np.array([shares[d] * (held.sum() if of == "total" else held[i]) if d in shares
                        else held[i] for i, d in enumerate(model.domains)])
    history, unmet = solve(members, targets, steps)
    for i in np.flatnonzero(unmet):
        LOG.warning("domain %s: target %.0f tokens, unmet by %+.0f after %d steps",
                    model.domains[i], targets[i], unmet[i], len(history))
    return members, history


def mix(docs: DataFrame, model: Classifier, shares: dict[str, float], of: str = "total",
        steps: int = 60) -> DataFrame:
    """(doc_id, n_tokens, p, rate) for every row of `docs`; rates are 0 or more.

    A domain's target is its share `of` all tokens ("total") or of the tokens it now
    holds ("domain"); domains not named keep what they hold. Null and empty texts
    have no tokens and get a rate by their posteriors; repeated rows get equal
    rates; extra columns are ignored; no rows give none. Targets that no rates can
    reach are met in the least-squares sense, and the gaps are logged as warnings.
    """
    members, history = plan(docs, model, shares, of, steps)
    schema = f"{members.schema[0].simpleString().replace(':', ' ', 1)}, n_tokens long, " \
             "p array<double>, rate double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates_of(_matrix(batch), history) if batch.num_rows else np.zeros(0)
            yield batch.append_column("rate", pa.array(r, pa.float64()))

    return members.mapInArrow(scan, schema)


def draws(batch: pa.RecordBatch, seen: dict[bytes, int]) -> np.ndarray:
    """A number in [0, 1) for each row, from doc_id, text and how often `seen` had both."""
    from xxhash import xxh64_intdigest, xxh128_digest
    out = np.empty(batch.num_rows)
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    for i, (key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts)):
        row = xxh128_digest(f"{key!r}:".encode() + (b"" if text is None else b"=" + text))
        nth = seen[row] = seen.get(row, -1) + 1
        out[i] = (xxh64_intdigest(row + nth.to_bytes(8, "little"), 42) >> 11) / 2.0 ** 53
    return out


def resample(docs: DataFrame, model: Classifier, shares: dict[str, float], of: str = "total",
             steps: int = 60) -> DataFrame:
    """`docs` with each row as often as its rate says.

    The second pass over the texts computes each row's rate where the row is, so no
    join moves the texts. A row stays as often as its rate's whole part says, and once
    more if its draw is below the rest, so that the expected totals are those of the
    rates. Columns stay as they are.
    """
    _, history = plan(docs, model, shares, of, steps)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        counter, seen = terms.Counter(m.vocabulary), {}
        for batch in sliced(batches, limit=terms.SLICE_BYTES):
            texts = batch.column("text")
            words = terms.Words(texts)
            row, term, _ = counter.count(words)
            p = m.posterior(batch.num_rows, row, term, shape(words, texts.fill_null("")))
            rates = np.round(rates_of(p, history), 9)  # a whole rate may be a hair below
            whole = np.floor(rates)
            times = (whole + (draws(batch, seen) < rates - whole)).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return docs.mapInArrow(copies, docs.schema)
