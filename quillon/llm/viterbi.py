"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; going through them by their end, the
dynamic programme keeps for each place the best score and its number of pieces. Tie rules are those of the
unigram tokenizer: a path replaces another only if it scores strictly more, and of the pieces that end at a
place the longest is tried first. A character that is no piece by itself costs the least piece score less ten
and counts as its UTF-8 bytes (byte fallback).

Text is cut into words as the tokenizer does: every space begins a word and is written as U+2581, and a text
that does not begin with one gets one. Words are counted once for each task's recent ones.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from quillon.llm.blocks import pieces, trimmed

SPACE, PENALTY, MOST_WORDS = "▁", 10.0, 400_000
VOCABULARY = os.environ.get("QUILLON_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def zipf(n: int) -> list[float]:
    """Log-probabilities of n pieces by Zipf's law of their rank."""
    norm = math.log(sum(1 / r for r in range(1, n + 1)))
    return [-math.log(r) - norm for r in range(1, n + 1)]


def vocabulary(path: str = VOCABULARY, scores: Callable[[int], list[float]] = zipf) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with the log-probabilities that `scores` gives to their number, in order; control, byte and unknown pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), s) for i, s in zip(ids, scores(len(ids)))]


def counter(pieces_: list[tuple[str, float]]):
    """A function from a word to its number of tokens."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in pieces_:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min((s for _, s in pieces_), default=0.0) - PENALTY
    matches = automaton.iter if len(pieces_) else lambda w: ()

    def count(word: str) -> int:
        n = len(word)
        best, number = [0.0] * (n + 1), [0] * (n + 1)
        at, single, reached = 0, False, False

        def close(end: int) -> None:
            """A place without a one-character piece can also be reached by the unknown one."""
            nonlocal single, reached
            if not single and (not reached or best[end - 1] + unknown > best[end]):
                best[end] = best[end - 1] + unknown
                number[end] = number[end - 1] + len(word[end - 1].encode())
            single = reached = False

        for end, (size, score) in matches(word):
            end += 1
            while at < end - 1:
                at += 1
                close(at)
            s = best[end - size] + score
            if not reached or s > best[end]:
                best[end], number[end], reached = s, number[end - size] + 1, True
            single = single or size == 1
        while at < n:
            at += 1
            close(at)
        return number[n]

    return count


def words_of(text: str) -> list[str]:
    if not text:
        return []
    if text[0] != " ":
        text = " " + text
    return text[1:].split(" ")


def counts(shared, most: int = MOST_WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = counter(shared.value), {}
        for keys, texts in pieces(batches, "text", "doc_id", 1 << 20):
            chars, n_words, n_tokens = [], [], []
            for t in texts:
                text = t.decode()
                words = words_of(text)
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = count(SPACE + w)
                        if len(w) < 64:
                            known[w] = n
                    total += n
                chars.append(len(text))
                n_words.append(len(words))
                n_tokens.append(total)
            if len(known) > most:
                known.clear()
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(chars, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Tokens of each whole text of docs(doc_id, text, ...) under a vocabulary of (piece, score): doc_id, n_chars, n_pretokens, n_tokens.

    The vocabulary is read by the driver and broadcast; its size is that of a tokenizer, whatever the input. Null and
    empty text have no tokens; white space other than the space is an ordinary character. Of paths with equal
    scores the one by the rules above counts. Rows repeat as they come, a null doc_id stays, and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(trimmed(counts(shared)), "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents: doc_id, n_chars, n_pretokens, n_tokens. Edge cases as in token_counts."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
