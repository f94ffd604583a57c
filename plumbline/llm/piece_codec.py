"""SentencePiece encoding and decoding by a table of last tokens, for merge-type (BPE) models.

Of the merge rule's result for a text, all tokens but the last are its result for the text
without the last one. So a text has a table: for each prefix, the one token its result ends
with. An automaton over all pieces gives the pieces that end at a place; of these, that one is
stored which can stand beside the last token of the prefix before it. Two tokens can, if
merging their joined text gives them back; the answers are remembered. The ids are then read
backwards from the last entry. This takes one step per match, however long the text is.

Characters that no piece has become bytes and end a table. A space (written U+2581) after
another character starts one as well where no piece reaches over it, so words are encoded
once and remembered. Decoding joins the pieces' bytes, with marks for what is not UTF-8.

Defined cases: null text is empty and has no ids; null and repeated ids are documents of their
own; an empty table gives no rows; further columns are ignored; texts of any length are encoded
whole; U+2581 in a text is a space, as in the library. Ids that stand for no piece raise.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import texts
from plumbline.sources.tables import spread

SPACE = "▁"
CACHED_WORDS = 200_000
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 40  # characters
UNKNOWN_SHOWN = " ⁇ ".encode()  # fixed value: how the library shows an unknown id
REPLACED = "�".encode()


class _Words(dict):
    """Ids (packed) of a word with what stands before it: a space, or nothing."""

    def __init__(self, model: PieceModel, lead: str):
        super().__init__()
        self.model, self.lead = model, lead

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.table_ids(self.lead + word), "<i4").tobytes()
        if len(word) <= LONGEST_CACHED and len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        if library.normalize(" Ａ  b ") != f"{SPACE}{SPACE}Ａ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that keep characters and add a space are supported")
        if any(map(library.is_unused, range(size))):
            raise ValueError("models with unused pieces are not supported")
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(library.is_byte, self.byte_ids)):
            raise ValueError("only models with a piece for every byte are supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        #: Bytes of each id in a decoded text.
        self.shown: list[bytes] = [b""] * size
        self.is_byte = np.zeros(size, bool)
        self.leads = np.zeros(size, bool)  # pieces that start with a space
        self.plain = np.zeros(size, bool)  # neither control nor unknown
        self.is_byte[self.byte_ids] = True
        for byte, id_ in enumerate(self.byte_ids):
            self.shown[id_] = bytes([byte])
        for id_ in range(size):
            piece = library.id_to_piece(id_)
            if library.is_control(id_) or self.is_byte[id_]:
                continue
            if library.is_unknown(id_):
                self.shown[id_] = UNKNOWN_SHOWN
                continue
            self.ids[piece] = id_
            self.scores[piece] = library.get_score(id_)
            self.shown[id_] = piece.replace(SPACE, " ").encode()
            self.leads[id_] = piece.startswith(SPACE)
        self.plain[list(self.ids.values())] = True
        self.plain |= self.is_byte
        self.pieces = {id_: piece for piece, id_ in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, id_ in self.ids.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (id_, len(piece)))
        self.automaton.make_automaton()
        self.known = set("".join(self.ids))
        #: Whether a space after another character always starts a piece.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words, self.inner = _Words(self, SPACE), _Words(self, "")
        probe = "A probe of 12 words,\n<s> Ａ and   blanks."
        if self.encode(probe).tolist() != library.encode(probe):
            raise ValueError("not a merge-type model")

    def merged(self, text: str) -> list[str]:
        """The merge rule itself on a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side."""
        found = self.pairs.get((left, right))
        if found is None:
            one, other = self.pieces[left], self.pieces[right]
            found = self.merged(one + other) == [one, other]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def table_ids(self, text: str) -> list[int]:
        """Ids of a text in which spaces are written U+2581."""
        if not self.known.issuperset(text):
            out, start = [], 0
            for at, char in enumerate(text):
                if char not in self.known:
                    out += self.table_ids(text[start:at])
                    out += [self.byte_ids[b] for b in char.encode()]
                    start = at + 1
            return out + self.table_ids(text[start:])
        last: list[int | None] = [None] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (id_, length) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - length
            if start:
                before = last[start]
                found = pairs.get((before, id_))
                if found is None:
                    found = compatible(before, id_)
                if not found:
                    continue
            last[end], back[end] = id_, start
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.cuts:
            return self.words[text.replace(" ", SPACE)]
        if "  " in text or text[0] == " ":
            words = [w[1:].replace(" ", SPACE) for w in re.findall(r" +[^ ]*", " " + text)]
        else:
            words = text.split(" ")
        if "\n" in text and "\n" not in self.known:
            ids, end = [], np.array(self.byte_ids[10], "<i4").tobytes()
            for word in words:
                first, *later = word.split("\n")
                ids.append(self.words[first])
                for part in later:
                    ids.append(end + self.inner[part] if part else end)
            return b"".join(ids)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids, as the library's decode gives it."""
        if len(ids) == 0:
            return ""
        if ids.min() < 0 or ids.max() >= len(self.shown):
            raise ValueError("an id stands for no piece")
        joined = b"".join(map(self.shown.__getitem__, ids.tolist()))
        if self.plain[ids].all():
            try:
                text = joined.decode()
                return text[1:] if self.leads[ids[0]] else text
            except UnicodeDecodeError:
                pass
        return self._decode_piecewise(ids)

    def _decode_piecewise(self, ids: np.ndarray) -> str:
        out: list[bytes] = []
        run = bytearray()
        first, stripped = True, False  # a space is taken off the first piece with any text

        def flush() -> None:
            at = 0
            while at < len(run):
                for length in (1, 2, 3, 4):
                    try:
                        bytes(run[at : at + length]).decode()
                        out.append(bytes(run[at : at + length]))
                        at += length
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append(REPLACED)
                    at += 1
            run.clear()

        for id_ in ids.tolist():
            if self.is_byte[id_]:
                run += self.shown[id_]
                continue
            flush()
            if stripped or any(out):
                first = False
            shown = self.shown[id_]
            stripped = bool(first and self.leads[id_])
            out.append(shown[1:] if stripped else shown)
        flush()
        return b"".join(out).decode()


@functools.lru_cache(maxsize=1)
def model_at(path: str) -> PieceModel:
    """One model per worker process, so that its memory of words outlives a task."""
    return PieceModel(path)


def round_trip(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded): ids of each whole text, and the text that these ids give."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            ids = [model.encode(text.as_py()) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, []]), pa.int32()))
            decoded = pa.array(map(model.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, decoded], schema=schema)

    rows = spread(texts(docs, id_col, text_col))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def decoded(
    tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text, a null id in them is left
    out."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            ids = (np.array(row or [], np.int64) for row in batch.column("ids").to_pylist())
            made = pa.array(map(model.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], schema=schema)

    rows = tokens.select(
        tokens[id_col].cast("bigint").alias("doc_id"),
        F.array_compact(tokens[ids_col].cast("array<int>")).alias("ids"),
    )
    return rows.mapInArrow(run, "doc_id bigint, text string")


def digest(rows: DataFrame) -> DataFrame:
    """One row per document with the number of ids and hashes of ids and decoded text."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
