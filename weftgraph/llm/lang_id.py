"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, in lower case. A word's emission scores sum the weights of its affixes (1 to 4
letters), its letter bigrams and trigrams, all hashed into one table, and of its entry in a lexicon of words
that the training sample holds more than once. Transitions between the languages of neighbouring words are
learned with the rest by gradient ascent on the chain's likelihood. Forward-backward then gives each word a
posterior over languages, so mixed texts are labelled word by word; a document's language has the largest
sum of posteriors, weighted by letters, and its score is that share.

Training labels are known per document only. A first fit gives all words their document's language; its
posteriors, under sticky transitions, relabel the words, so foreign passages take their own language; the
chain is then fitted to those labels. It uses a hash sample of about ``SAMPLE`` labelled documents, with about
``LEAST`` of each language or all it has, and all words of each; the fit cuts them into chains of ``PIECE`` words,
so only the transitions at the cuts are not learned from. All other work covers whole texts as one chain each.

Defined results: ``und`` with score 0 where the text is null or has no letter, or if nothing could be
learned; ties go to the language first by code point; a null lang teaches nothing; words and texts of any length
are read whole; an empty table gives an empty result; repeated rows are labelled each; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, named, sampled, small_batches, text_slices, worker_cache

SAMPLE = 3_000
#: Documents to learn a language from, where it has so many.
LEAST = 100
PIECE = 256
BITS = 16
WORDS = r"[^\W\d_]+"
CACHE = 200_000
#: Numbers in one padded array of likelihoods.
CELLS = 1_000_000
#: Letters of words looked at at once; a longer word is looked at alone.
LETTERS = 400_000


def by_length(words: list[str]) -> Iterator[list[int]]:
    """The words' places in groups of like length and bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    first = 0
    for k, i in enumerate(order):
        if k > first and (k + 1 - first) * len(words[i]) > LETTERS:
            yield order[first:k]
            first = k
    if order:
        yield order[first:]


def slots(words: list[str], lexicon: dict[str, int]):
    """(word, feature) matrix of rows of the weight table; row 0 is no feature."""
    import numpy as np

    n = len(words)
    width = max(map(len, words))
    c = np.array(words, f"<U{width}").view("<u4").reshape(n, width).astype(np.uint64)
    c = np.concatenate([c, np.zeros((n, 4), np.uint64)], axis=1)
    size = np.array([len(w) for w in words])
    mask = np.uint64((1 << BITS) - 1)

    def hashed(value, salt: int):
        h = (value + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & mask).astype(np.int32) + 1

    b = np.uint64(21)
    out = [np.array([lexicon.get(w, 0) for w in words], np.int32)]
    gram = [c, c[:, :-1] | c[:, 1:] << b, c[:, :-2] | c[:, 1:-1] << b | c[:, 2:] << np.uint64(42)]
    rows = np.arange(n)
    for k in (1, 2, 3):
        out.append(np.where(size >= k, hashed(gram[k - 1][:, 0], k), 0))
        out.append(np.where(size >= k, hashed(gram[k - 1][rows, np.maximum(size - k, 0)], 10 + k), 0))
    four = gram[2][rows, np.maximum(size - 4, 0)] ^ c[rows, np.maximum(size - 1, 0)] * np.uint64(0x2545F4914F6CDD1D)
    out.append(np.where(size >= 4, hashed(four, 20), 0))
    inner = []
    for k in (2, 3):
        if (places := width - k + 1) > 0:
            inner.append(np.where(size[:, None] >= np.arange(k, places + k), hashed(gram[k - 1][:, :places], 30 + k), 0))
    return np.concatenate([np.stack(out, 1), *inner], 1)


def summed(table, found):
    """The sums of the found rows of a table, by row of found."""
    import numpy as np

    e = np.zeros((len(found), table.shape[1]), np.float32)
    step = max(1, CELLS // 4 // max(1, e.size))
    for j in range(0, found.shape[1], step):
        e += table[found[:, j : j + step]].sum(1)
    return e


def forward_backward(p, transition, start, lengths, weights=None, pairs: bool = False):
    """Posteriors of padded sequences p(time, sequence, label), sequences ordered from long to short.

    With weights(time, sequence) only their weighted sums over time come back. pairs adds the expected
    number of each transition."""
    import numpy as np

    t_max, b, l = p.shape
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(t_max + 1)]  # sequences longer than t
    alpha = np.empty_like(p)
    a = p[0] * start
    a /= a.sum(1, keepdims=True)
    alpha[0] = a
    for t in range(1, t_max):
        n = alive[t]
        a = (a[:n] @ transition) * p[t, :n]
        a /= a.sum(1, keepdims=True)
        alpha[t, :n] = a
    total = np.zeros((b, l))
    gamma = np.zeros_like(p) if weights is None else None
    counts = np.zeros((l, l))
    back = np.ones((b, l), p.dtype)
    for t in range(t_max - 1, -1, -1):
        n = alive[t]
        g = alpha[t, :n] * back[:n]
        g /= g.sum(1, keepdims=True)
        if gamma is None:
            total[:n] += g * weights[t, :n, None]
        else:
            gamma[t, :n] = g
        if t:
            after = back[:n] * p[t, :n]
            if pairs:
                x = alpha[t - 1, :n, :, None] * transition * after[:, None, :]
                counts += (x / x.sum((1, 2), keepdims=True)).sum(0)
            after = after @ transition.T
            back[:n] = after / after.sum(1, keepdims=True)
    return total if gamma is None else (gamma, counts)


@dataclass
class Chain:
    langs: list[str] = field(default_factory=list)
    lexicon: dict[str, int] = field(default_factory=dict)
    table: object = None  # (1 + 2^BITS + lexicon, languages) float32
    transition: object = None  # logarithms
    start: object = None

    def emissions(self, words: list[str]):
        """Scores of each word for each language, less the largest, as float32 likelihoods."""
        import numpy as np

        out = np.empty((len(words), len(self.langs)), np.float32)
        for part in by_length(words):
            e = summed(self.table, slots([words[i] for i in part], self.lexicon))
            out[part] = np.exp(e - e.max(1, keepdims=True)) + 1e-12
        return out


def _sequences(ids: list, emissions, langs: int) -> Iterator:
    """Padded likelihoods and lengths of sequences ordered from long to short, in groups of bounded size, with their places."""
    import numpy as np

    at = 0
    while at < len(ids):
        longest = len(ids[at])
        group = ids[at : at + max(1, CELLS // (longest * langs))]
        p = np.ones((longest, len(group), langs), np.float32)
        for k, x in enumerate(group):
            p[: len(x), k] = emissions[x]
        yield at, p, np.array([len(x) for x in group])
        at += len(group)


def fit(samples: list[tuple[str, list[str]]], first: int = 40, rounds: int = 12, ridge: float = 1e-6) -> Chain:
    """From (language, words) of each sampled document."""
    import numpy as np

    pieces = ((lang, words[k : k + PIECE]) for lang, words in samples for k in range(0, len(words), PIECE))
    samples = sorted(pieces, key=lambda x: (-len(x[1]), x))
    langs = sorted({x for x, _ in samples})
    if not langs:
        return Chain()
    n, index = len(langs), {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words]) for _, words in samples]
    flat = np.concatenate(ids)
    words = list(index)
    often = np.bincount(flat, minlength=len(words))
    lexicon = {w: 1 + (1 << BITS) + k for k, w in enumerate(w for w, c in zip(words, often, strict=True) if c > 1)}
    groups = [(g, slots([words[i] for i in g], lexicon)) for g in by_length(words)]
    model = Chain(langs, lexicon, np.zeros((1 + (1 << BITS) + len(lexicon), n), np.float32))
    square = np.zeros_like(model.table)

    def scores():
        e = np.empty((len(words), n), np.float32)
        for g, found in groups:
            e[g] = summed(model.table, found)
        return e

    def ascend(gradient, rate: float) -> None:
        """One Adagrad step on the table, given the gradient by word."""
        full = np.zeros_like(model.table)
        for g, found in groups:
            for k in range(n):
                full[:, k] += np.bincount(found.ravel(), np.repeat(gradient[g, k], found.shape[1]), len(full))
        full -= ridge * len(flat) * model.table
        full[0] = 0
        square[:] += full**2
        model.table += (rate * full / (np.sqrt(square) + 1e-3)).astype(np.float32)

    label = np.concatenate([np.full(len(x), langs.index(lang)) for (lang, _), x in zip(samples, ids, strict=True)])
    seen = np.bincount(flat * n + label, minlength=len(words) * n).reshape(-1, n)
    for _ in range(first):
        e = scores()
        q = np.exp(e - e.max(1, keepdims=True))
        ascend(seen - q / q.sum(1, keepdims=True) * seen.sum(1, keepdims=True), 0.3)
    like = lambda: np.exp((e := scores()) - e.max(1, keepdims=True)) + 1e-12
    sticky = np.full((n, n), 0.02 / max(1, n - 1)) + np.eye(n) * (0.98 - 0.02 / max(1, n - 1))
    start = np.bincount([langs.index(x) for x, _ in samples], minlength=n) / len(samples)
    told = []
    for at, p, lengths in _sequences(ids, like(), n):
        gamma, _ = forward_backward(p, sticky.astype(np.float32), start.astype(np.float32), lengths)
        told += [gamma[: len(x), k].argmax(1) for k, x in enumerate(ids[at : at + len(lengths)])]
    observed = np.bincount(np.concatenate([t[:-1] * n + t[1:] for t in told]), minlength=n * n).reshape(n, n)
    target = np.bincount(flat * n + np.concatenate(told), minlength=len(words) * n).reshape(-1, n)
    model.transition, model.start = np.log(sticky), np.log(start + 1e-6)
    moved = np.zeros((n, n))
    for _ in range(rounds):
        weight = np.exp(model.transition).astype(np.float32)
        expected, post = np.zeros((n, n)), []
        for at, p, lengths in _sequences(ids, like(), n):
            gamma, moves = forward_backward(p, weight, np.exp(model.start).astype(np.float32), lengths, pairs=True)
            expected += moves
            post += [gamma[: len(x), k] for k, x in enumerate(ids[at : at + len(lengths)])]
        post = np.concatenate(post)
        ascend(target - np.stack([np.bincount(flat, post[:, k], len(words)) for k in range(n)], 1), 0.1)
        slope = observed - expected
        moved += slope**2
        model.transition = model.transition + 0.3 * slope / (np.sqrt(moved) + 1.0)
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Chain:
    known = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang")).filter((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row a language, of which there are few.
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    share, wanted = sample / sum(counts.values()), F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == lang) & sampled(F.col("doc_id"), max(share, LEAST / n), 13))

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        find = re.compile(WORDS).findall
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([" ".join(find(t.lower())) for t in part.column("text").to_pylist()])], ["lang", "words"])

    rows = known.filter(wanted).mapInArrow(run, "lang string, words string").collect()
    return fit([(r.lang, r.words.split()) for r in rows])


class Labeller:
    """A chain with the emissions of words met before."""

    def __init__(self, model: Chain):
        import re

        import numpy as np

        self.model = model
        self.find = re.compile(WORDS).findall
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)), np.float32)
        self.transition = np.exp(model.transition).astype(np.float32)
        self.start = np.exp(model.start).astype(np.float32)

    def words(self, text: str | None) -> list[str]:
        words = self.find((text or "").lower())
        if words and not words[0].isalpha() and not any(map(str.isalpha, words)):
            return []
        return words

    def ids(self, words: list[list[str]]):
        """Word numbers of each text, and how to forget the new ones if there are too many."""
        import numpy as np

        new = list(set().union(*words).difference(self.known))
        first = len(self.known)
        if new:
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            grown = np.concatenate([self.rows[:first], self.model.emissions(new)])
            self.rows = grown
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int32, sum(map(len, words)))
        return flat, (new, first)

    def forget(self, new: list[str], first: int) -> None:
        if len(self.known) > CACHE:
            for w in new:
                del self.known[w]
            self.rows = self.rows[:first]

    def shares(self, texts: list[str | None]):
        """For each text the share of its letters that each language holds; zeros without a letter."""
        import numpy as np

        words = [self.words(t) for t in texts]
        out = np.zeros((len(texts), len(self.model.langs)))
        lengths = np.array([len(w) for w in words])
        flat, (new, first) = self.ids(words)
        letters = np.fromiter(map(len, chain.from_iterable(words)), np.float32, len(flat))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(-lengths, kind="stable")
        order = order[: int((lengths > 0).sum())]
        while len(order):
            t_max = int(lengths[order[0]])
            fit_in = max(1, min(512, CELLS // (t_max * out.shape[1])))
            part, order = order[:fit_in], order[fit_in:]
            n = lengths[part]
            p = np.ones((t_max, len(part), out.shape[1]), np.float32)
            w = np.zeros((t_max, len(part)), np.float32)
            for k, d in enumerate(part):
                span = slice(begin[d], begin[d + 1])
                p[: n[k], k] = self.rows[flat[span]]
                w[: n[k], k] = letters[span]
            total = forward_backward(p, self.transition, self.start, n, w)
            out[part] = total / total.sum(1, keepdims=True)
        self.forget(new, first)
        return out


def language_report(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    import uuid

    own = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = worker_cache("lang_id")
        if own not in cache:
            cache.clear()
            cache[own] = Labeller(model) if model.langs else None
        labeller = cache[own]
        for batch in batches:
            for part in text_slices(batch, "text", 2_000_000):
                if labeller is None:
                    best, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                else:
                    shares = labeller.shares(part.column("text").to_pylist())
                    score = shares.max(1)
                    best = [model.langs[k] if s > 0 else "und" for k, s in zip(shares.argmax(1), score, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(best), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(run, "doc_id long, lang_pred string, score double"), "lang")
