"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a maximal run of characters other than white space, with a boundary mark before it.
Its tokens are the most probable split into vocabulary pieces (Viterbi): the forward score of a
prefix is the best over the pieces that end there, so it is the same for every pre-token that
shares the prefix.  A batch's distinct pre-tokens are inserted in a trie and scored in one pass over
its nodes: a node's score is computed once, from its ancestors, and a terminal node stores its
number of tokens.  A character that no piece covers counts as its UTF-8 bytes.

The vocabulary's pieces come in order of rank; a piece's score is the logarithm of Zipf's law on
its rank, so no probabilities are trained here.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: distinct pre-tokens whose counts a worker keeps
KEPT = 400_000


class Model:
    """Pieces and scores, filed by their last characters for the scan backwards from a node."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores = scores
        self.byte_score = byte_score
        self.longest = max(map(len, scores), default=1)


@functools.lru_cache(maxsize=2)
def zipf_model(path: str, exponent: float = 1.0) -> Model:
    """Model of a sentencepiece file: piece of rank r has the score -exponent * log(r + 1) - log(sum)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum((r + 1) ** -exponent for r in range(len(pieces))))
    # single characters stand at the end of the file; bytes are rarer than any piece
    scores = {p: -exponent * math.log(r + 1) - total for r, p in enumerate(pieces)}
    return Model(scores, -exponent * math.log(len(pieces) + 2) - total - 1)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def trie_counts(words: list[str], model: Model) -> dict[str, int]:
    """Tokens of every distinct word (with its mark), each trie node scored once.

    Words in sorted order are the trie's depth-first order: the path from the root to the current
    node is the common prefix kept from the word before, with the scores of its nodes.
    """
    out: dict[str, int] = {}
    scores, longest, byte_score = model.scores, model.longest, model.byte_score
    best, tokens = [0.0], [0]  # forward score and token count of the path's nodes
    before = ""
    for word in sorted(set(words)):
        shared = 0
        top = min(len(before), len(word))
        while shared < top and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1:], tokens[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top_score, count = best[end - 1] + n * byte_score, tokens[end - 1] + n
            for start in range(max(0, end - longest), end):
                score = scores.get(word[start:end])
                if score is not None and (score := score + best[start]) >= top_score:
                    # of equal scores the one of fewer tokens
                    if score > top_score or tokens[start] + 1 < count:
                        top_score, count = score, tokens[start] + 1
            best.append(top_score)
            tokens.append(count)
        out[word] = tokens[-1]
        before = word
    return out


#: pre-token -> tokens, per model file, kept over a worker's tasks
_KNOWN: dict[str, dict[str, int]] = {}


def _count(path: str):
    def run(batches):
        model, known = zipf_model(path), _KNOWN.setdefault(path, {})
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000).to_pylist()
                cut = [[] if t is None else t.split() for t in texts]
                new = {w for words in cut for w in words}.difference(known)
                if len(known) + len(new) > KEPT:
                    known.clear()
                    new = {w for words in cut for w in words}
                known.update((w[1:], n) for w, n in trie_counts([MARK + w for w in new], model).items())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(list(map(len, cut)), pa.int64()),
                     pa.array([sum(map(known.__getitem__, words)) for words in cut], pa.int64())],
                    names=["doc_id", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every whole text.

    Cases: a null or empty text, or white space alone, has none; a null id keeps its row; repeated
    rows count alike; between splits of equal score the one of fewer tokens is taken; other columns
    are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_count(path or vocabulary_path()), "doc_id long, n_pretokens long, n_tokens long")
