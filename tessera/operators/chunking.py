"""Chunks of sections: paragraphs, else sentences, else words, packed greedily with an overlap.

Packing is sequential within a section, so a section is cut by one small function in Python,
which Spark applies to whole sections; sections are spread like any rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 500, 50
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]+\)")
_CJK = re.compile("[一-鿿㐀-䶿]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_CLAUSE = re.compile("(?<=[，、；：。！？「」（）『』【】])")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a section. Text with few blank lines gets one after each line that ends a CJK
    sentence. A paragraph with an image takes in the next one, unless that has an image too."""
    text = text.strip()
    double = text.count("\n\n")
    if double <= 0.3 * (text.count("\n") - 2 * double):
        text = re.sub(r"(?m)([。！？])[^\S\n]*$", r"\1\n", text)
    out: list[str] = []
    takes = False
    for part in filter(None, map(str.strip, re.split(r"\n{2,}", text))):
        image = _IMAGE.search(part) is not None
        if takes and not image:
            out[-1] += "\n\n" + part
            takes = False
        else:
            out.append(part)
            takes = image
    return out


@dataclass(frozen=True)
class Chunker:
    size: int = SIZE
    overlap: int = OVERLAP

    def tail(self, text: str) -> str:
        """The end of a text of about ``overlap`` characters, from the first word that begins in it."""
        if self.overlap <= 0 or len(text) <= self.overlap:
            return text if self.overlap > 0 else ""
        end = text[-self.overlap :]
        if (space := end.find(" ")) >= 0:
            return end[space + 1 :]
        if not _CJK.search(text):
            return ""
        clause = _CLAUSE.search(end)
        return end[clause.end() :] if clause else end

    def last_words(self, words: list[str], gap: int) -> list[str]:
        """The last of ``words`` that fit in the overlap."""
        room, first = self.overlap, len(words)
        while first and len(words[first - 1]) + (gap if first < len(words) else 0) <= room:
            first -= 1
            room -= len(words[first]) + (gap if first + 1 < len(words) else 0)
        return words[first:]

    def pack(self, pieces: list[str], joint: str, split, carry) -> list[str]:
        """Join pieces while they fit; ``split(piece)`` cuts one that is too long (None: it stays whole), and
        ``carry(pieces of a full chunk)`` gives those that begin the next."""
        out: list[str] = []
        held: list[str] = []
        length = 0
        for piece in pieces:
            if len(piece) > self.size and split:
                if held:
                    out.append(joint.join(held))
                held, length = [], 0
                out += split(piece)
                continue
            gap = len(joint) if held else 0
            if held and length + gap + len(piece) > self.size:
                out.append(joint.join(held))
                held = carry(held)
                length = sum(map(len, held)) + len(joint) * max(0, len(held) - 1)
            held.append(piece)
            length += gap + len(piece)
        if held:
            out.append(joint.join(held))
        return out

    def words(self, text: str) -> list[str]:
        """A long sentence by words; text without spaces by clauses, else letter by letter."""
        units, joint = text.split(), " "
        if len(units) <= 1 and _CJK.search(text):
            units = _CLAUSE.split(text)
            units = [u for u in (units if len(units) > 1 else list(text)) if u.strip()]
        if _CJK.search(text) and " " not in text:
            joint = ""
        return self.pack(units, joint, None, lambda held: self.last_words(held, len(joint)))

    def sentences(self, text: str) -> list[str]:
        return self.pack(_SENTENCE.split(text), " ", self.words, self._last_tail)

    def _last_tail(self, held: list[str]) -> list[str]:
        tail = self.tail(held[-1])
        return [tail] if tail else []

    def chunks(self, text: str) -> list[str]:
        """The chunks of a section; a paragraph with an image is never cut."""
        whole = lambda p: [p] if _IMAGE.search(p) else self.sentences(p)
        return self.pack(paragraphs(text), "\n\n", whole, self._last_tail)


def chunk_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, section, title, vehicle_model, codes, text, has_image) of sections(id, nth, title, vehicle_model, codes,
    body); chunks are numbered through a document. Null and blank bodies give none."""
    chunker = Chunker(size, overlap)

    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([chunker.chunks(b) if b and b.strip() else [] for b in bodies.to_pylist()], pa.list_(pa.string()))

    # a section keeps its chunks as an array until they are numbered, so they are cut once and stay where the sections are
    cut = sections.withColumn("chunks", F.arrow_udf(run, "array<string>")("body"))
    before = F.sum(F.size("chunks")).over(Window.partitionBy("id").orderBy("nth")) - F.size("chunks")
    placed = cut.withColumn("before", before).select("id", "before", "nth", "title", "vehicle_model", "codes", F.posexplode("chunks").alias("part", "text"))
    return placed.select(
        "id", (F.col("before") + F.col("part")).alias("chunk_index"), F.col("nth").alias("section"), "title", "vehicle_model", "codes", "text", F.col("text").rlike(r"!\[[^\]]*\]\([^)]+\)").alias("has_image"),
    )
