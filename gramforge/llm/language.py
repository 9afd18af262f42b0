"""Language identification by a linear-chain conditional random field.

Words are labelled; emissions sum weights of character n-grams (with marks at a word's ends, so prefixes and suffixes
too) and of a lexicon of frequent words, transitions are learned from chains spliced of several languages, and
forward-backward gives every word's marginals. A text's language is the one with the largest mean marginal.
A text is one chain. Its pieces of CHAIN words are gone through side by side: each piece is first made a matrix from the
message that enters it to the one that leaves it, these carry the messages over the pieces, and then every piece is
gone through with those of both its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import SLICE_BYTES, Words, slices
from gramforge.llm.runtime import ship_code

GRAMS = (2, 3, 4)
BITS = 15
CHAIN = 64
LEXICON = 4000
#: The fit's bounds: rows of each language and code points of a row; of a longer row a piece at a hashed place is used.
#: More than MAX_LANGS languages are an error.
FIT_ROWS, FIT_CHARS, MAX_LANGS = 250, 6000, 256
STEPS, CHAINS, RATE = 160, 64, 0.15
UNKNOWN = "und"
GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordTable:
    """The distinct words of some texts with the features of each: hashed n-gram codes, ragged."""

    def __init__(self, words: Words):
        self.hash, first, self.at = np.unique(words.hash, return_index=True, return_inverse=True)
        begin, end = words.begin[first], words.end[first]
        sizes = end - begin
        marked = sizes + 2
        start = np.cumsum(marked) - marked
        total = int(marked.sum())
        text = np.full(total + 4, 2, np.uint64)
        text[start] = 1
        body = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = words.raw[np.repeat(begin, sizes) + body]
        text[np.repeat(start + 1, sizes) + body] = letters
        alpha = (letters >= 97).astype(np.int64)
        self.has_letter = np.add.reduceat(alpha, np.cumsum(sizes) - sizes) > 0 if total else np.zeros(0, bool)
        place = np.arange(total) - np.repeat(start, marked)
        left = np.repeat(marked, marked) - place
        codes, gram = [], text[:total].copy()
        for n in range(2, max(GRAMS) + 1):
            gram = (gram << np.uint64(8)) | text[n - 1 : total + n - 1]
            if n in GRAMS:
                code = ((gram + np.uint64(n)) * GRAM_FACTOR) >> np.uint64(64 - BITS)
                codes.append(np.where(left >= n, code.astype(np.int64), 1 << BITS))
        self.codes = np.stack(codes, axis=1) if total else np.zeros((0, len(GRAMS)), np.int64)
        self.start, self.marked = start, marked


class Crf:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.weights = np.zeros(((1 << BITS) + 1, n), np.float32)
        self.lexicon = np.zeros(0, np.uint64)
        self.lexicon_weights = np.zeros((0, n), np.float32)
        self.transitions = np.eye(n, dtype=np.float32)

    def _lexical(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the lexicon, -1 if it isn't there."""
        if not len(self.lexicon):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, -1)

    def emissions(self, table: WordTable) -> np.ndarray:
        """Of each distinct word; words without letters say nothing."""
        if not len(table.hash):
            return np.zeros((0, len(self.langs)), np.float32)
        each = self.weights[table.codes[:, 0]]
        for k in range(1, table.codes.shape[1]):
            each += self.weights[table.codes[:, k]]
        out = np.add.reduceat(each, table.start, axis=0)
        at = self._lexical(table.hash)
        out[at >= 0] += self.lexicon_weights[at[at >= 0]]
        out[~table.has_letter] = 0
        return out

    def carried(self, scores: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For pieces of chains (place, piece, label): the matrix (piece, label, label) from the message that reaches a
        piece's first place to the one that its last place sends, to a factor."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.transitions)
        out = np.eye(scores.shape[2], dtype=np.float32) * e[0][:, None, :]
        for t in range(1, len(e)):
            step = (out @ a) * e[t][:, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            out = np.where(live[t][:, None, None], step, out)
        return out

    def marginals(self, scores: np.ndarray, live: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward on chains side by side: scores (place, chain, label), live (place, chain). For pieces of
        chains, the messages that reach the first place (to be multiplied with its score) and the last one. Also the
        expected transitions, summed."""
        places, chains, n = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.transitions)
        forward = np.empty_like(e)
        begin = e[0] if enter is None else e[0] * enter
        forward[0] = begin / begin.sum(axis=1, keepdims=True)
        for t in range(1, places):
            f = (forward[t - 1] @ a) * e[t]
            forward[t] = f / f.sum(axis=1, keepdims=True)
        back = np.ones((chains, n), np.float32) if leave is None else leave
        out = np.empty_like(e)
        moved = np.zeros((n, n))
        for t in range(places - 1, -1, -1):
            m = forward[t] * back
            out[t] = m / m.sum(axis=1, keepdims=True)
            if t:
                ahead = e[t] * back
                joint = (forward[t - 1][:, :, None] * a) * ahead[:, None, :]
                moved += (joint * (live[t] / joint.sum(axis=(1, 2)))[:, None, None]).sum(axis=0) if self.fitting else 0
                b = ahead @ a.T
                back = np.where(live[t][:, None], b / b.sum(axis=1, keepdims=True), back)
        return out, moved

    fitting = False

    def fit(self, texts: list[str], labels: list[int], seed: int = 5) -> Crf:
        words = Words(pa.array(texts, pa.large_string()))
        table = WordTable(words)
        n = len(self.langs)
        if not len(table.hash) or not n:
            return self
        owner = np.repeat(np.array(labels), words.counts())
        counts = np.bincount(table.at, minlength=len(table.hash))
        common = np.sort(np.argsort(-counts, kind="stable")[:LEXICON])
        common = common[counts[common] > 1]
        self.lexicon, self.lexicon_weights = table.hash[common], np.zeros((len(common), n), np.float32)
        lexical = self._lexical(table.hash)
        g = np.random.Generator(np.random.PCG64(seed))
        usable = np.flatnonzero(words.counts() > 0)
        by_lang = [usable[np.array(labels)[usable] == k] for k in range(n)]
        by_lang = [x for x in by_lang if len(x)]
        seen = [np.full(w.shape, 1e-6, np.float32) for w in (self.weights, self.lexicon_weights, self.transitions)]
        self.fitting = True
        for _ in range(STEPS):
            chosen = np.zeros((CHAIN, CHAINS), np.int64)
            for c in range(CHAINS):
                filled = 0
                while filled < CHAIN:
                    own = by_lang[g.integers(len(by_lang))]
                    d = own[g.integers(len(own))]
                    begin = g.integers(words.bounds[d], words.bounds[d + 1])
                    size = min(int(g.geometric(1 / 24)), CHAIN - filled, words.bounds[d + 1] - begin)
                    chosen[filled : filled + size, c] = np.arange(begin, begin + size)
                    filled += size
            kinds, at = np.unique(table.at[chosen], return_inverse=True)
            at = at.reshape(chosen.shape)
            sizes = table.marked[kinds]
            rows = np.repeat(table.start[kinds], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            codes = table.codes[rows]
            score = np.add.reduceat(self.weights[codes].sum(axis=1), np.cumsum(sizes) - sizes, axis=0)
            lex = lexical[kinds]
            score[lex >= 0] += self.lexicon_weights[lex[lex >= 0]]
            score[~table.has_letter[kinds]] = 0
            gold = owner[chosen]
            probable, moved = self.marginals(score[at], np.ones(chosen.shape, bool))
            error = -probable
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) + 1, 2)
            by_word = np.stack([np.bincount(at.reshape(-1), weights=error[:, :, k].reshape(-1), minlength=len(kinds)) for k in range(n)], axis=1)
            by_word[~table.has_letter[kinds]] = 0
            by_word /= CHAINS
            spread = np.repeat(np.repeat(by_word, sizes, axis=0), codes.shape[1], axis=0)
            flat = codes.reshape(-1)
            grad = np.stack([np.bincount(flat, weights=spread[:, k], minlength=len(self.weights)) for k in range(n)], axis=1)
            steps = np.zeros((n, n))
            np.add.at(steps, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), 1)
            lex_grad = np.zeros_like(self.lexicon_weights)
            lex_grad[lex[lex >= 0]] = by_word[lex >= 0]
            for w, s, d in zip((self.weights, self.lexicon_weights, self.transitions), seen, (grad, lex_grad, (steps - moved) / CHAINS), strict=True):
                d = d - 1e-4 * w
                s += (d * d).astype(np.float32)
                w += (RATE * d / np.sqrt(s)).astype(np.float32)
            self.weights[-1] = 0
        self.fitting = False
        return self

    def word_marginals(self, words: Words) -> np.ndarray:
        """Marginals (word, label) of all words of the texts."""
        n = len(self.langs)
        counts = words.counts()
        table = WordTable(words)
        score = self.emissions(table)
        chains = -(-counts // CHAIN)
        total = int(chains.sum())
        out = np.zeros((len(words.hash), n), np.float32)
        if not total:
            return out
        inner = np.arange(total) - np.repeat(np.cumsum(chains) - chains, chains)
        start = np.repeat(words.bounds[:-1], chains) + inner * CHAIN
        size = np.minimum(CHAIN, np.repeat(counts, chains) - inner * CHAIN)
        order = np.argsort(size, kind="stable")
        groups = [order[i : i + 4096] for i in range(0, total, 4096)]

        def laid(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            places = np.arange(int(size[own].max()))[:, None]
            live = places < size[own]
            at = np.where(live, start[own] + places, start[own])
            return np.where(live[:, :, None], score[table.at[at]], np.float32(0)), live, at

        enter, leave = np.ones((total, n), np.float32), np.ones((total, n), np.float32)
        several = np.repeat(chains > 1, chains)
        if several.any():
            carried = np.empty((total, n, n), np.float32)
            for own in groups:
                if len(own := own[several[own]]):
                    scores, live, _ = laid(own)
                    carried[own] = self.carried(scores, live)
            a = np.exp(self.transitions)
            lasts = np.cumsum(chains) - 1
            firsts = lasts - chains + 1
            for step in range(1, int(chains.max())):  # pieces of the longest text
                texts = np.flatnonzero(chains > step)
                c = firsts[texts] + step
                now = np.einsum("cj,cjk->ck", enter[c - 1], carried[c - 1]) @ a
                enter[c] = now / now.max(axis=1, keepdims=True)
                c = lasts[texts] - step
                now = np.einsum("cjk,ck->cj", carried[c + 1], leave[c + 1]) @ a.T
                leave[c] = now / now.max(axis=1, keepdims=True)
        for own in groups:
            scores, live, at = laid(own)
            made, _ = self.marginals(scores, live, enter[own], leave[own])
            out[at[live]] = made[live]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        words = Words(texts)
        made = self.word_marginals(words)
        counts = words.counts()
        upto = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(made, axis=0, dtype=np.float64)])
        mean = (upto[words.bounds[1:]] - upto[words.bounds[:-1]]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        for i, t in enumerate(texts.to_pylist()):
            if t and counts[i] and any(map(str.isalpha, t)):
                names[i], scores[i] = self.langs[best[i]], min(1.0, max(0.0, float(mean[i, best[i]])))
        return names, scores


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Crf:
    """A model of the languages of the rows not held out, fitted on at most `rows` of each, drawn by a hash of the id and
    the text. Rows without a text or language are left out, repeated rows count once, of texts beyond FIT_CHARS code points a
    piece of so many is fitted on, cut at white space where it has some; without any row there is no language to
    predict. docs is read twice, whatever the number of languages."""
    known = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    known = known.select("l", "t", F.xxhash64("i", "t").alias("h"))
    found = known.groupBy("l").agg(F.approx_count_distinct("h", 0.05).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r[0] for r in found)
    # twice the distinct rows of each language are drawn on average, then the least hashes are taken
    share = {r[0]: min(1.0, 2 * rows / max(1, r[1])) for r in found}
    if not langs:
        return Crf([])
    below = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, share[lang])]), F.col("l"))
    over = F.char_length("t") - FIT_CHARS
    piece = F.regexp_replace(F.substring("t", F.pmod("h", over + 1).cast("int") + 1, F.lit(FIT_CHARS)), r"^\S*\s|\s\S*$", "")
    drawn = known.filter(F.pmod("h", F.lit(1 << 30)) < below * (1 << 30)).select("l", "h", F.when(over > 0, piece).otherwise(F.col("t")).alias("t")).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = {lang: [] for lang in langs}
    for lang, h, t in sorted(drawn.collect(), key=lambda r: (r[0], r[1] % (1 << 30), r[1])):
        if len(order[lang]) < rows:
            order[lang].append((lang, t))
    got = [x for own in order.values() for x in own]
    return Crf(langs).fit([t for _, t in got], [langs.index(lang) for lang, _ in got])


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (mean marginal) of every row, by its whole text, however long. Texts that are null or
    have no letter are `und` with score 0; repeated rows are alike; other columns are left out."""
    ship_code(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t", SLICE_BYTES * 4 // max(4, len(held.value.langs))):
            names, scores = held.value.predict(piece.column("t"))
            yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
