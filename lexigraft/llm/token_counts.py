"""Token counts of texts under a unigram vocabulary, scored once per shared prefix."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigraft.llm.common import Memory, map_batches

MARK = "▁"
#: How far the score of a character without a piece lies below the lowest score, as in common unigram tokenizers.
UNKNOWN_PENALTY = 10.0
#: Pre-tokens a task remembers, in each of two halves.
REMEMBERED = 300_000


class UnigramPieces:
    """Pieces with scores, stored as a trie over reversed pieces.

    The forward step at a position looks for pieces that end there, so the trie is walked backwards
    over the text. A character without a piece counts as many tokens as it has UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def step(self, text: str, end: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Best score of ``text[:end]`` and its number of tokens, from those of all shorter prefixes.

        Among equal scores the one with fewer tokens wins.
        """
        best, tokens, node, at = None, 0, self.root, end
        while at > 0:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            own = node.get("")
            if own is not None:
                total, n = score[at] + own, count[at] + 1
                if best is None or total > best or total == best and n < tokens:
                    best, tokens = total, n
        if text[end - 1] not in self.root or "" not in self.root[text[end - 1]]:
            total, n = score[end - 1] + self.unknown, count[end - 1] + len(text[end - 1].encode("utf-8"))
            if best is None or total > best or total == best and n < tokens:
                best, tokens = total, n
        return best, tokens


def count_distinct(words: list[str], pieces: UnigramPieces) -> dict[str, int]:
    """Number of tokens of each distinct word.

    The words are the terminals of a trie; in sorted order that is its depth-first walk, and the stacks
    hold the forward scores along the current path. A prefix shared by several words is scored once.
    """
    counts: dict[str, int] = {}
    score, count, path = [0.0], [0], ""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(path))
        while shared < most and word[shared] == path[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            s, n = pieces.step(word, end, score, count)
            score.append(s)
            count.append(n)
        counts[word], path = count[len(word)], word
    return counts


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces and scores of a sentencepiece model file; control, byte and unused ones are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        p.id_to_piece(i): p.get_score(i)
        for i in range(p.get_piece_size())
        if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i) or p.is_unused(i))
    }


def count_tokens(
    docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pre-tokens and tokens of every text: ``(id_col, n_words, n_tokens)``, one row per input row.

    A pre-token is a run without white space with the mark ``▁`` before it. Null and empty texts have
    none; repeated rows and null ids are counted like all others; other columns are ignored. The vocabulary
    is broadcast, it does not grow with the corpus. Each batch puts its distinct pre-tokens in a trie; counts
    found are remembered in the task, in a bounded memory. No text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    kind = dict(docs.dtypes)[id_col]

    def make():
        pieces = UnigramPieces(shared.value)
        known: Memory = Memory(lambda w: None, REMEMBERED)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [(t or "").encode("utf-8").split() for t in batch.column(1).to_pylist()]
            found, new = {}, []
            for word in {w for t in texts for w in t}:
                n = known.peek(word)
                if n is None:
                    new.append(word)
                else:
                    found[word] = n
            fresh = {w: MARK + w.decode("utf-8") for w in new}
            counts = count_distinct(list(fresh.values()), pieces)
            for word, marked in fresh.items():
                found[word] = known.put(word, counts[marked])
            return {
                id_col: batch.column(0),
                "n_words": [len(t) for t in texts],
                "n_tokens": [sum(map(found.__getitem__, t)) for t in texts],
            }

        return work

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
