"""Licence texts in documents: phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import blocks_by_length, map_batches

#: Phrases whose words must stand next to each other, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice, and the runs of words that tell its licence from others: a block must hold one of them."""

    label: str
    notice: str
    marks: tuple[str, ...]


_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the {name} as published "
    "by the free software foundation either version {version} of the license or at your option any later version"
)


def _gnu(label: str, name: str, short: str, version: str) -> list[Template]:
    """The short and the full notice of a version of a GNU licence."""
    named = tuple(f"{x} {v}{version}" for x in (name, f"gnu {short}") for v in ("version ", "v", "v ", ""))
    return [
        Template(label, f"licensed under the {name} version {version}", named),
        Template(
            label,
            _GPL.format(name=name, version=version),
            tuple(f"{name} as published by the free software foundation {x}version {version} " for x in ("", "either ")),
        ),
    ]


def _creative(label: str, kind: str, words: str) -> list[Template]:
    """The short and the long name of a Creative Commons licence, version 4.0."""
    return [
        Template(label, f"licensed under cc {kind} 4 0", (f"cc {kind} 4 0",)),
        Template(label, f"licensed under a creative commons {words} 4 0 international license", (f"creative commons {words} 4 0",)),
    ]


#: Notices in the words of the public licences, and what tells them apart. Fixed values.
TEMPLATES = (
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("bsd", "released under the bsd license", ("the bsd license", "bsd 3 clause", "bsd 2 clause")),
    *_creative("cc-by-4.0", "by", "attribution"),
    *_creative("cc-by-nc-4.0", "by nc", "attribution noncommercial"),
    *_creative("cc-by-nd-4.0", "by nd", "attribution noderivatives"),
    *_creative("cc-by-sa-4.0", "by sa", "attribution sharealike"),
    *_creative("cc-by-nc-nd-4.0", "by nc nd", "attribution noncommercial noderivatives"),
    *_creative("cc-by-nc-sa-4.0", "by nc sa", "attribution noncommercial sharealike"),
    *_gnu("agpl-3.0", "gnu affero general public license", "agpl", "3"),
    *_gnu("gpl-2.0", "gnu general public license", "gpl", "2"),
    *_gnu("gpl-3.0", "gnu general public license", "gpl", "3"),
    *_gnu("lgpl-2.1", "gnu lesser general public license", "lgpl", "2 1"),
    *_gnu("lgpl-3.0", "gnu lesser general public license", "lgpl", "3"),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "permission to use copy modify and distribute this software"),
    ),
    Template("mit", "released under the mit license", ("the mit license", "mit licensed")),
    Template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the mozilla public license version 2 0",
        ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"),
    ),
)

#: A block is so many consecutive words, however lines are broken, and starts every half of them: a notice
#: of up to half a block's words stands whole in some block. The longest given one has 44.
BLOCK_WORDS = 128

#: A word is a run of ASCII digits and letters and of characters beyond ASCII. Bytes, after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
THRESHOLD = 0.8
#: Bytes of texts that a task has as Python lists at a time; one text at least.
BATCH_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def spaced(words: list[bytes]) -> bytes:
    """The words with one space before and after each."""
    return b" " + b" ".join(words) + b" "


def block_starts(n_words: int, size: int) -> range:
    """Where the blocks of a text of so many words start."""
    return range(0, max(1, n_words - size // 2), size // 2)


@dataclass
class TemplateIndex:
    """Templates as sets in global frequency order, and the inverted index over their prefixes.

    ``prefix[token]`` lists (template, position of the token in the template's order). A block that
    holds ``need`` of a template's tokens holds at least one of its ``size - need + 1`` rarest ones.
    """

    labels: list[str]
    sets: list[list[bytes]]
    marks: list[list[bytes]]
    need: list[int]
    prefix: dict[bytes, list[tuple[int, int]]]

    @classmethod
    def build(cls, templates: Sequence[Template], frequency: dict[bytes, int], threshold: float) -> TemplateIndex:
        labels, sets, marks, need, prefix = [], [], [], [], {}
        for t in templates:
            tokens = sorted(set(words_of(t.notice)), key=lambda x: (frequency.get(x, 0), x))
            if not tokens:
                raise ValueError(f"template {t.label} has no words")
            least = max(1, ceil(round(threshold * len(tokens), 9)))
            for position, token in enumerate(tokens[: len(tokens) - least + 1]):
                prefix.setdefault(token, []).append((len(labels), position))
            labels.append(t.label)
            sets.append(tokens)
            marks.append([spaced(words_of(m)) for m in t.marks] or [b" "])
            need.append(least)
        return cls(labels, sets, marks, need, prefix)

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Every label whose template the block holds at least the threshold of, and one mark, with the best containment."""
        best: dict[int, int] = {}
        block = set(words)
        for token in self.prefix.keys() & block:
            for k, position in self.prefix[token]:
                best[k] = min(best.get(k, position), position)
        found: dict[str, float] = {}
        text = b""
        for k, position in best.items():
            tokens, need = self.sets[k], self.need[k]
            # Length filter; positional filter: nothing before the first common token is in the block.
            if len(block) < need or len(tokens) - position < need:
                continue
            shared = sum(t in block for t in tokens[position:])
            if shared >= need:
                text = text or spaced(words)
                if any(m in text for m in self.marks[k]):
                    label = self.labels[k]
                    found[label] = max(found.get(label, 0.0), shared / len(tokens))
        return sorted(found.items())


def token_frequencies(
    docs: DataFrame, tokens: set[bytes], text_col: str = "text", block_words: int = BLOCK_WORDS
) -> dict[bytes, int]:
    """In how many blocks of all documents each of the templates' tokens stands.

    The answer has one number per template token, however large the corpus is.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            counts: Counter = Counter()
            for part in blocks_by_length(batch, 0, BATCH_BYTES):
                for text in part.column(0).to_pylist():
                    words = words_of(text)
                    for i in block_starts(len(words), block_words):
                        counts.update(tokens.intersection(words[i : i + block_words]))
            return {"token": list(counts), "n": list(counts.values())}

        return work

    counted = map_batches(docs.select(text_col), make, "token binary, n bigint")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Places of phrases and blocks that contain licence templates, for every document.

    A block is a window of ``block_words`` words, starting every half of that; line breaks, comment signs and
    punctuation do not matter. It matches a template if it holds at least ``threshold`` of the distinct words of
    the template's notice and one of its marks word by word: words alone cannot tell MIT from BSD, or one version from
    another. The join is exact: tokens in ascending frequency over the whole corpus, prefix, length and
    positional filters, then the count and the marks.

    Returns ``(id_col, n_words, places ARRAY<STRUCT<label, word>>, blocks ARRAY<STRUCT<label, word,
    containment>>)``, one row per input row; ``word`` is where the phrase or the block starts. A licence that stands in
    the overlap of two blocks is found in both. Null and empty texts have no words; very long texts are
    scanned whole; repeated rows and null ids are scanned like all others; other columns are ignored; an empty
    table gives an empty one.
    """
    if block_words < 2:
        raise ValueError("block_words must be at least 2")
    frequency = token_frequencies(docs, {w for t in templates for w in words_of(t.notice)}, text_col, block_words)
    index = TemplateIndex.build(templates, frequency, threshold)
    spelled = [(p.encode("utf-8").split(), label) for p, label in sorted(phrases.items())]
    kind = dict(docs.dtypes)[id_col]

    def make():
        rare = index.prefix.keys()

        def places(words: list[bytes], held: set[bytes]) -> list[dict]:
            out = []
            for phrase, label in spelled:
                if held.issuperset(phrase):
                    at, last = -1, len(words) - len(phrase)
                    for _ in range(words.count(phrase[0])):
                        at = words.index(phrase[0], at + 1)
                        if at <= last and words[at : at + len(phrase)] == phrase:
                            out.append({"label": label, "word": at})
            return out

        def blocks(words: list[bytes], held: set[bytes]) -> list[dict]:
            if held.isdisjoint(rare):
                return []
            return [
                {"label": label, "word": i, "containment": part}
                for i in block_starts(len(words), block_words)
                for label, part in index.matches(words[i : i + block_words])
            ]

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for rows in blocks_by_length(batch, 1, BATCH_BYTES):
                n_words, all_places, all_blocks = [], [], []
                for text in rows.column(1).to_pylist():
                    words = words_of(text)
                    held = set(words)
                    n_words.append(len(words))
                    all_places.append(places(words, held))
                    all_blocks.append(blocks(words, held))
                yield {id_col: rows.column(0), "n_words": n_words, "places": all_places, "blocks": all_blocks}

        return work

    return map_batches(
        docs.select(id_col, text_col),
        make,
        f"`{id_col}` {kind}, n_words bigint, places array<struct<label: string, word: bigint>>, "
        "blocks array<struct<label: string, word: bigint, containment: double>>",
    )
