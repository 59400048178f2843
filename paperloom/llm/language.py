"""Problem 8: language of every document and of every sentence in another language.

Segmentation-marginalised unigrams. The pieces are those of a fixed public vocabulary. Each language
has a probability for each piece; a forward algorithm sums the probability of a word over all its
segmentations into pieces, and a sentence is the product of its words. The probabilities come from
expectation maximisation over a bounded sample of labelled rows, which is relabelled sentence by
sentence before the last rounds because labels are noisy.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.sentences import paragraphs, sentence_spans
from paperloom.session import tokenizer_dir

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
# Usual spellings of the languages, beside the two-letter codes.
NAMES = {
    "de": "deu ger german deutsch allemand",
    "en": "eng english englisch anglais",
    "es": "spa spanish castilian español espanol espagnol",
    "fr": "fra fre french français francais französisch",
    "it": "ita italian italiano italien",
    "nl": "nld dut dutch flemish nederlands vlaams",
    "pt": "por portuguese português portugues portugais",
}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
FLOOR = 1e-9  # probability of a character that no piece of a language begins or holds
SHORT = 24  # words up to this length are summed as they are, longer ones in logarithms
OTHER, OTHER_CHAR = "und", 1e-2  # a text in none of the languages: every character as likely as this


def label_language(label: Column) -> Column:
    """The language a label names, as a two-letter code; null where it names none of LANGUAGES."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_\-(/.]+)", 1)
    out = F.when(word.isin(*LANGUAGES), word)
    for code, names in NAMES.items():
        out = out.when(word.isin(*names.split()), F.lit(code))
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sentences_of(text: str, start: int, end: int) -> list[list[str]]:
    """The words of each sentence of a paragraph; a fragment of under two words joins the sentence before it."""
    out: list[list[str]] = []
    for a, b in line_spans(text, start, end):
        words = words_of(text[a:b])
        if out and not two_words(words):
            out[-1] += words
        else:
            out.append(words)
    return out if not out or two_words(out[0]) else out[1:]


def two_words(words: list[str]) -> bool:
    """Whether there are two words or more of two letters or more."""
    first = False
    for w in words:
        if len(w) > 1:
            if first:
                return True
            first = True
    return False


def line_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Sentence spans; here items of a list count each for itself, as each may be in its own language."""
    at = start
    for block in re.split(r"(?<=\n)(?=[ \t]*(?:[-*•]|\(?\w{1,3}[.)])[ \t])", text[start:end]):
        if block.strip():
            yield from ((at + a, at + b) for a, b in sentence_spans(block, 0, len(block)))
        at += len(block)


class PieceModel:
    """Piece probabilities of each language over one fixed vocabulary."""

    def __init__(self, pieces: dict[str, int], probabilities: np.ndarray):
        self.pieces, self.p = pieces, probabilities
        self.heads = {piece[:k] for piece in pieces for k in range(1, len(piece))}
        self.cache: dict[str, np.ndarray] = {}

    def segments(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of all pieces inside the marked word; every character is a piece."""
        w = "▁" + word
        get, heads, size = self.pieces.get, self.heads, len(w)
        out = []
        for a in range(size):
            b = a + 1
            k = get(w[a])
            out.append((a, b, -1 if k is None else k))
            while b < size and w[a:b] in heads:
                b += 1
                k = get(w[a:b])
                if k is not None:
                    out.append((a, b, k))
        return out

    def forward(self, word: str) -> np.ndarray:
        """Log probability of the word in each language, summed over all segmentations."""
        known = self.cache.get(word)
        if known is None:
            known = self.summed(word) if len(word) <= SHORT else self.summed_in_logs(word)
            if len(self.cache) > 400_000:
                self.cache.clear()
            self.cache[word] = known
        return known

    def summed(self, word: str) -> np.ndarray:
        alpha = np.zeros((len(word) + 2, self.p.shape[1]))
        alpha[0] = 1.0
        for a, b, k in self.segments(word):
            alpha[b] += alpha[a] * (self.p[k] if k >= 0 else FLOOR)
        return np.log(alpha[-1])

    def summed_in_logs(self, word: str) -> np.ndarray:
        alpha = np.full((len(word) + 2, self.p.shape[1]), -np.inf)
        alpha[0] = 0.0
        for a, b, k in self.segments(word):
            alpha[b] = np.logaddexp(alpha[b], alpha[a] + (np.log(self.p[k]) if k >= 0 else np.log(FLOOR)))
        return alpha[-1]

    def score(self, words: list[str]) -> np.ndarray:
        return np.sum([self.forward(w) for w in words], axis=0)

    def posteriors(self, sentences: list[list[str]]) -> np.ndarray:
        """The probability of each language, and of none of them, for each sentence, all sentences at once."""
        if not sentences:
            return np.zeros((0, self.p.shape[1] + 1))
        number: dict[str, int] = {}
        at = [number.setdefault(w, len(number)) for ws in sentences for w in ws]
        table = np.array([self.forward(w) for w in number])
        other = np.log(OTHER_CHAR) * (1 + np.fromiter(map(len, number), dtype=float, count=len(number)))
        begin = np.concatenate([[0], np.cumsum([len(ws) for ws in sentences])[:-1]])
        s = np.add.reduceat(np.column_stack([table, other])[at], begin, axis=0)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, sentence: str) -> np.ndarray:
        return self.posteriors([words_of(sentence)])[0]

    def expect(self, word: str, language: int, weight: float, into: np.ndarray) -> None:
        """Add the expected piece counts of a word (forward-backward) to `into`."""
        seg = self.segments(word)
        if len(word) > 4 * SHORT:  # of no use for the counts, which are of the words that recur
            return
        n = len(word) + 1
        p = [float(self.p[k, language]) if k >= 0 else FLOOR for _, _, k in seg]
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        for (a, b, _), q in zip(seg, p):
            alpha[b] += alpha[a] * q
        for (a, b, _), q in zip(reversed(seg), reversed(p)):
            beta[a] += beta[b] * q
        if alpha[n] > 0:
            for (a, b, k), q in zip(seg, p):
                if k >= 0:
                    into[k] += weight * alpha[a] * q * beta[b] / alpha[n]


def vocabulary(path: str | None = None) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or f"{tokenizer_dir()}/piece_bpe_32k.model")
    return [sp.id_to_piece(k) for k in range(sp.get_piece_size())]


def fit(rows: list[tuple[str, str]], vocab: list[str], rounds: int = 4) -> PieceModel:
    """Fit by expectation maximisation over (language, text) rows; sentences choose their language
    anew before each round of the second half."""
    pieces: dict[str, int] = {}
    for piece in vocab:
        low = piece.lower()
        if re.fullmatch(r"▁?[^\W\d_'’]*(?:['’][^\W\d_]*)*", low) and low not in pieces:
            pieces[low] = len(pieces)
    sentences = [(LANGUAGES.index(lang), ws) for lang, t in rows for a, z in paragraphs(t) for ws in sentences_of(t, a, z)]
    for _, ws in sentences:
        for c in {c for w in ws for c in w}:
            pieces.setdefault(c, len(pieces))
    model = PieceModel(pieces, np.full((len(pieces), len(LANGUAGES)), 1.0 / len(pieces)))
    for r in range(rounds):
        if r >= rounds // 2:
            sentences = [(int(np.argmax(np.sum([model.forward(w) for w in ws], axis=0))), ws) for _, ws in sentences if ws]
        counts: dict[int, Counter] = defaultdict(Counter)
        for k, ws in sentences:
            counts[k].update(ws)
        expected = np.zeros((len(LANGUAGES), len(pieces)))
        for k, words in counts.items():
            for w, c in words.items():
                model.expect(w, k, float(c), expected[k])
        pooled = expected.sum(axis=0) + 0.01
        pooled /= pooled.sum()
        smooth = expected + 20.0 * pooled
        model = PieceModel(pieces, (smooth / smooth.sum(axis=1, keepdims=True)).T.copy())
    return model


def train(documents: DataFrame, per_language: int = 300, chars: int = 4000) -> PieceModel:
    """Fit on at most `per_language` labelled rows of each language, at most `chars` of each.

    The bound holds for the fit alone; every row is labelled with the result.
    """
    labelled = documents.where(F.length(F.trim("text")) > 0).select("doc_id", label_language(F.col("lang")).alias("code"), F.substring("text", 1, chars).alias("text")).where("code is not null")
    ranked = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    # row_number() <= n is pruned to n rows a language in every task before the shuffle
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h"))
    kept = ranked.withColumn("rn", rank).where(F.col("rn") <= per_language).select("code", "text")
    return fit(sorted((r["code"], r["text"]) for r in kept.collect()), vocabulary())


SCHEMA = "doc_id bigint, para_no int, sent_no int, lang string, confidence double"


def sentence_languages(documents: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, para_no, sent_no, lang, confidence of every sentence; label: what the row's label names."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.pieces, model.p.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, p = shared.value
        local = PieceModel(pieces, p.astype(np.float64))
        for batch in (part.iloc[a : a + 500] for part in batches for a in range(0, max(len(part), 1), 500)):
            rows, found = [], []
            for d, label, t in zip(batch["doc_id"], batch["label"], batch["text"]):
                for n, (a, z) in enumerate(paragraphs(t or ""), 1):
                    for k, words in enumerate(sentences_of(t, a, z), 1):
                        rows.append((d, n, k, label))
                        found.append(words)
            out = pd.DataFrame(rows, columns=["doc_id", "para_no", "sent_no", "label"])
            q = local.posteriors(found)
            best = q.argmax(axis=1) if len(q) else np.zeros(0, dtype=int)
            out["lang"] = np.array([*LANGUAGES, OTHER], dtype=object)[best]
            out["confidence"] = q[np.arange(len(q)), best]
            yield out[["doc_id", "para_no", "sent_no", "lang", "confidence", "label"]]

    return documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).mapInPandas(run, SCHEMA + ", label string")


def foreign_paragraphs(sentences: DataFrame) -> DataFrame:
    """doc_id, para_no, lang: languages of a paragraph's sentences that the label does not name."""
    return sentences.where((F.col("lang") != OTHER) & ~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", F.col("para_no").cast("int").alias("para_no"), "lang").distinct()


def document_languages(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row per document: its main language, the confidence of it, and its share of the sentences.

    A document without a sentence (null, blank, figures) has no language: null, confidence and share 0. `und`
    stands for text in none of LANGUAGES. Rows that repeat a doc_id count together.
    """
    per = sentences.groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    main = per.groupBy("doc_id").agg(F.max_by(F.struct("lang", "c", "n"), F.struct("n", "c", "lang")).alias("m"), F.sum("n").alias("total"))
    zero = F.lit(0.0)
    return (
        documents.select("doc_id")
        .distinct()
        .join(main, "doc_id", "left")
        .select("doc_id", F.col("m.lang").alias("lang"), F.coalesce(F.round("m.c", 6), zero).alias("confidence"), F.coalesce(F.round(F.col("m.n") / F.col("total"), 6), zero).alias("share"))
    )


def segments(sentences: DataFrame) -> DataFrame:
    """doc_id, para_no, first_sentence, last_sentence, lang, confidence of each run of sentences of a paragraph
    that are in one language; the confidence is the mean of theirs."""
    place = Window.partitionBy("doc_id", "para_no").orderBy("sent_no")
    marked = sentences.select("doc_id", "para_no", "sent_no", "lang", "confidence").distinct().withColumn("new", (~F.lag("lang").over(place).eqNullSafe(F.col("lang"))).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(place))
    return runs.groupBy("doc_id", "para_no", "run", "lang").agg(F.min("sent_no").alias("first_sentence"), F.max("sent_no").alias("last_sentence"), F.round(F.avg("confidence"), 6).alias("confidence")).drop("run")
