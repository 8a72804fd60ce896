"""Language identification by unigram models over a fixed public vocabulary of word pieces.

Each language has a probability for each piece. A word's probability is the sum over all its segmentations
into pieces, which a forward pass adds up; a text's is the product over its words. Piece probabilities come
from expectation maximisation over the counts of all words of all labelled texts: a forward-backward pass
per word gives the expected number of times each piece is used.

Word counts are summed by Spark over the whole input; expected piece counts likewise, and only they, at most
pieces times languages, reach the driver. Words are runs of letters, lower-cased; other characters say nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import Numbered, letter_words
from cohortspan.sources.staging import stage

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
UNDETERMINED = "und"
#: Passes of expectation maximisation; added to each expected count.
PASSES, SMOOTHING = 2, 0.05
#: Labelled languages; more are an error, as the driver holds a table of pieces for each.
MOST_LANGUAGES = 500
#: More than the characters of any piece.
LONGEST_PIECE = 1024
#: Words and scores a task remembers, counted words it holds before it passes them on, and characters it scores at once.
REMEMBERED, HELD, AT_ONCE = 150_000, 150_000, 500_000
#: The commonest words, which are scored once and sent with the model; words scored at once.
COMMON, SCORED = 60_000, 5_000
#: Longer words are scored one by one with rescaling, as their probability has no double, and counted in
#: logarithms, so many characters at once.
LONG, LONG_AT_ONCE = 48, 100_000


def read_pieces(path: str) -> list[str]:
    """Pieces by id. Control pieces and bytes are empty; piece 0 stands for a letter that no piece covers."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)
    return ["" if skip(i) else model.id_to_piece(i) for i in range(model.get_piece_size())]


class Lattice:
    """All pieces at all places of words."""

    def __init__(self, pieces: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            if piece and MARK not in piece[1:]:
                self.automaton.add_word(piece, i * LONGEST_PIECE + len(piece))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First node of each word (and one more), and start node, end node and piece of each edge.

        A word of n letters has n + 2 nodes: before its mark, after it and after each letter.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.concatenate(([0], np.cumsum(sizes + 2)))
        joined = MARK + ("\n" + MARK).join(words)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        uncovered = set(joined) - self.single - {"\n"}
        if uncovered:
            letters = [(at, 1) for at, c in enumerate(joined) if c in uncovered]
            found = np.concatenate((found, np.array(letters, np.int64)))
        end = found[:, 0] + 1
        piece, size = np.divmod(found[:, 1], LONGEST_PIECE)
        return firsts, end - size, end, piece


def _by_step(nodes: np.ndarray, firsts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The edges at each distance of their node from the word's first: indexes, where a node's begin, and the nodes."""
    step = nodes - firsts[np.searchsorted(firsts, nodes, side="right") - 1]
    order = np.lexsort((nodes, step))
    out = []
    for edges in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
        begins = np.flatnonzero(np.diff(nodes[edges], prepend=-1))
        out.append((edges, begins, nodes[edges[begins]]))
    return out


def forward(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Probability of each word under each language, a column of ``p``."""
    if not words:
        return np.zeros((0, p.shape[1]))
    firsts, start, end, piece = lattice.edges(words)
    reach = np.zeros((firsts[-1], p.shape[1]))
    reach[firsts[:-1]] = 1
    for edges, begins, nodes in _by_step(end, firsts):
        reach[nodes] = np.add.reduceat(reach[start[edges]] * p[piece[edges]], begins, axis=0)
    return reach[firsts[1:] - 1]


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is used in these words, over all segmentations, under one language ``p``."""
    firsts, start, end, piece = lattice.edges(words)
    ahead, back = np.zeros(firsts[-1]), np.zeros(firsts[-1])
    ahead[firsts[:-1]] = 1
    back[firsts[1:] - 1] = 1
    for edges, begins, nodes in _by_step(end, firsts):
        ahead[nodes] = np.add.reduceat(ahead[start[edges]] * p[piece[edges]], begins)
    for edges, begins, nodes in reversed(_by_step(start, firsts)):
        back[nodes] = np.add.reduceat(back[end[edges]] * p[piece[edges]], begins)
    word = np.searchsorted(firsts, start, side="right") - 1
    share = ahead[start] * p[piece] * back[end] / ahead[firsts[1:] - 1][word]
    return np.bincount(piece, share * counts[word], minlength=len(p))


def expected_long(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What ``expected`` gives, for words of any length: both passes in logarithms."""
    firsts, start, end, piece = lattice.edges(words)
    cost = np.log(p)[piece]
    ahead, back = np.zeros(firsts[-1]), np.zeros(firsts[-1])
    for reach, source, steps in ((ahead, start, _by_step(end, firsts)), (back, end, _by_step(start, firsts)[::-1])):
        for edges, begins, nodes in steps:
            path = reach[source[edges]] + cost[edges]
            top = np.maximum.reduceat(path, begins)
            sizes = np.diff(begins, append=len(edges))
            reach[nodes] = top + np.log(np.add.reduceat(np.exp(path - np.repeat(top, sizes)), begins))
    word = np.searchsorted(firsts, start, side="right") - 1
    share = np.exp(ahead[start] + cost + back[end] - ahead[firsts[1:] - 1][word])
    return np.bincount(piece, share * counts[word], minlength=len(p))


def log_forward_long(lattice: Lattice, word: str, p: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length: the forward pass, rescaled at each node."""
    _, start, end, piece = lattice.edges([word])
    incoming: dict[int, list[tuple[int, int]]] = {}
    for s, e, i in zip(start.tolist(), end.tolist(), piece.tolist()):
        incoming.setdefault(e, []).append((s, i))
    reach, scale = {0: np.ones(p.shape[1])}, {0: np.zeros(p.shape[1])}
    for node in range(1, len(word) + 2):
        top = np.max([scale[s] for s, _ in incoming[node]], axis=0)
        total = sum(reach[s] * np.exp(scale[s] - top) * p[i] for s, i in incoming[node])
        reach[node], scale[node] = np.ones(p.shape[1]), top + np.log(total)
        reach.pop(node - 64, None)
    return scale[len(word) + 1]


@dataclass
class LanguageModel:
    """Piece probabilities, a column for each language, log shares of the languages, and scores of the commonest words."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray
    log_share: np.ndarray
    common: list[str] = field(default_factory=list)
    common_scores: np.ndarray | None = None
    #: Mean log probability of a letter of a language in all words of that language's own texts; none if not asked for.
    usual: np.ndarray | None = None


_lattices: dict[int, Lattice] = {}


def _lattice(pieces: list[str]) -> Lattice:
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def frame() -> pd.DataFrame:
        rows = [(lang, w, n) for lang, counter in held.items() for w, n in counter.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, held.values())) > HELD:
                yield frame()
    yield frame()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts with a language."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counted = rows.mapInPandas(_count_words, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _usual(counts: DataFrame, model: LanguageModel) -> np.ndarray:
    """Mean log probability of a letter of each language, over all of its words (lang, word, n) as often as they occur."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    sent = counts.sparkSession.sparkContext.broadcast((model.pieces, model.p))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, p = sent.value
        lattice, total, letters = _lattice(pieces), np.zeros(p.shape[1]), np.zeros(p.shape[1])
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                column, n = number[lang], rows["n"].to_numpy(float)
                total[column] += n @ score_words(lattice, rows["word"].tolist(), p[:, [column]])[:, 0]
                letters[column] += n @ rows["word"].str.len().to_numpy(float)
        yield pd.DataFrame({"lang": np.arange(p.shape[1]), "total": total, "letters": letters})

    summed = counts.mapInPandas(weigh, "lang long, total double, letters double").groupBy("lang").agg(F.sum("total").alias("total"), F.sum("letters").alias("letters"))
    usual = np.full(len(number), -np.inf)
    for r in summed.where("letters > 0").collect():
        usual[r["lang"]] = r["total"] / r["letters"]
    # A language without words says nothing of what is usual.
    return usual


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, usual: bool = True) -> LanguageModel | None:
    """A model of the languages in column ``lang`` of ``docs``; none if no row has both a language and letters.

    What is ``usual`` takes one more pass over the counted words, which ``fits`` needs and ``identify`` does not.
    """
    pieces = read_pieces(vocabulary)
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = stage(word_counts(docs), "language-words")
    languages = sorted(shares)
    number = {lang: i for i, lang in enumerate(languages)}
    p = np.full((len(pieces), max(1, len(languages))), 1e-3)

    for _ in range(PASSES):

        def use(batches: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            lattice, used = _lattice(pieces), np.zeros_like(p)
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    column, is_long = number[lang], rows["word"].str.len() > LONG
                    short, long = rows[~is_long], rows[is_long]
                    if len(short):
                        used[:, column] += expected(lattice, short["word"].tolist(), short["n"].to_numpy(float), p[:, column])
                    at = 0
                    for part in batched(long["word"], LONG_AT_ONCE):
                        n = long["n"].iloc[at : at + len(part)].to_numpy(float)
                        used[:, column] += expected_long(lattice, part, n, p[:, column])
                        at += len(part)
            piece, lang = np.nonzero(used)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": used[piece, lang]})

        summed = counts.mapInPandas(use, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        if not len(summed):
            return None
        total = np.zeros_like(p)
        total[summed["piece"].to_numpy(int), summed["lang"].to_numpy(int)] = summed["n"].to_numpy(float)
        # A piece unseen in one language is as rare there as a piece seldom seen anywhere.
        total += SMOOTHING * (1 + total.sum(1, keepdims=True) / total.sum() * len(pieces)) / 2
        p = total / total.sum(0)
    documents = np.array([shares[x] for x in languages], float)
    model = LanguageModel(languages, pieces, p, np.log(documents / documents.sum()))
    # By grades of frequency, so that no more words reach the driver than are wanted; each language has its share.
    graded = counts.where(F.length("word") <= LONG).withColumn("grade", F.floor(4 * F.log2("n")))
    sizes: dict[str, dict[int, int]] = {}
    for r in graded.groupBy("lang", "grade").agg(F.count(F.lit(1)).alias("words")).collect():
        sizes.setdefault(r["lang"], {})[r["grade"]] = r["words"]
    least = []
    for lang, grades in sizes.items():
        left = COMMON // len(languages)
        for grade in sorted(grades, reverse=True):
            left -= grades[grade]
            if left < 0:
                break
            least.append((lang, grade))
    wanted = docs.sparkSession.createDataFrame(least, "lang string, grade long")
    rows = graded.join(F.broadcast(wanted), ["lang", "grade"]).select("word").distinct().collect()
    model.common = sorted(r["word"] for r in rows)
    model.common_scores = score_words(_lattice(pieces), model.common, p)
    if usual:
        model.usual = _usual(counts, model)
    return model


def score_words(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probabilities of words under each language. A few at a time, as a word has some thirty edges."""
    found = np.empty((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for a in range(0, len(short), SCORED):
        part = short[a : a + SCORED]
        found[part] = np.log(forward(lattice, [words[i] for i in part], p))
    for i in set(range(len(words))) - set(short) if len(short) < len(words) else ():
        found[i] = log_forward_long(lattice, words[i], p)
    return found


class Scorer:
    """Log probabilities of texts. Scores of words are kept, up to a bound, from one batch to the next."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, _lattice(model.pieces)
        # The commonest words come first and stay.
        self.known = Numbered(zip(model.common, range(len(model.common))))
        self.scores = np.zeros((0, len(model.languages))) if model.common_scores is None else model.common_scores
        self.fixed = len(model.common)

    def totals(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """Log probability of each text's words under each language, and how many letters they have."""
        split = [letter_words(t) if t else [] for t in texts]
        if len(self.known) > self.fixed + REMEMBERED:
            # What this batch uses again stays, and with it the common words.
            kept = list({w for words in split for w in words if self.known.get(w, -1) >= self.fixed})
            self.scores = np.concatenate((self.scores[: self.fixed], self.scores[[self.known[w] for w in kept]]))
            self.known = Numbered(zip(chain(self.model.common, kept), range(self.fixed + len(kept))))
        number = self.known.__getitem__
        index = [np.fromiter(map(number, words), np.int64, len(words)) for words in split]
        if self.known.new:
            self.scores = np.concatenate((self.scores, score_words(self.lattice, self.known.new, self.model.p)))
            self.known.new = []
        return [(self.scores[at].sum(0), sum(map(len, words))) for at, words in zip(index, split)]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior probability of each text."""
        out = []
        for total, letters in self.totals(texts):
            if not letters:
                out.append((UNDETERMINED, 0.0))
                continue
            total = total + self.model.log_share
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


#: Least posterior probability of a text's language, and how far its mean log probability of a letter may be below the language's own.
LEAST_POSTERIOR, FARTHEST = 0.5, 3.0


def fits(scorer: Scorer, texts: list[str | None]) -> list[bool]:
    """Whether each text is in one of the languages: likelier in it than in the others, and about as likely as its own texts are.

    A posterior alone says little, as of long texts one language always is by far the likeliest: another
    language or random letters are given away by improbable words, however many there are. Texts without letters do not fit.
    """
    out = []
    for total, letters in scorer.totals(texts):
        best = int(np.argmax(total + scorer.model.log_share))
        posterior = 1 / np.exp(total + scorer.model.log_share - (total + scorer.model.log_share)[best]).sum()
        usual = -np.inf if scorer.model.usual is None else scorer.model.usual[best]
        out.append(bool(letters) and posterior >= LEAST_POSTERIOR and total[best] >= (usual - FARTHEST) * letters)
    return out


def batched(texts: Iterable[str | None], most: int) -> Iterator[list[str | None]]:
    """Runs of texts of at most so many characters, or one longer text."""
    held, size = [], 0
    for text in texts:
        n = len(text) if text else 0
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score of every row: the likeliest language and its posterior probability.

    A null or empty text, and one without letters, is ``und`` with score 0; so is every text if nothing could
    be learned. Of equally likely languages the alphabetically first wins. Repeated rows are judged each.
    """
    schema = "doc_id long, lang_pred string, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [x for part in batched(batch["text"], AT_ONCE) for x in scorer(part)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return rows.mapInPandas(score, schema)
