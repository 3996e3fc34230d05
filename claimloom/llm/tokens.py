"""Whole-text encoding with a public tokenizer, each distinct piece of a group of texts encoded once.

Pieces met before are kept (at most KNOWN_PIECES of them a worker), so that small groups cost no more than large ones.

The vocabulary's pre-tokenizer lets a token span a space only as its first character, and no token crosses a space or
line break that has a non-space on both sides. A text in which every run of white space is one space or line break is
therefore cut there; Arrow finds the distinct pieces, the library encodes those, and NumPy puts the ids together. Texts
with other white space go to the library whole. Either way the ids are those of the whole text: a fixed probe is encoded
both ways when an encoder starts, and with a vocabulary for which the two differ every text goes to the library whole."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are encoded at once; distinct pieces whose ids a worker keeps.
GROUP_BYTES, KNOWN_PIECES = 4 << 20, 600_000
#: What an encoder tries both ways before it cuts texts into pieces.
PROBE = (
    "The quick brown fox, it's said. don't we'll I'm\nNext line here,\n",
    "Où est l'été? Größe straße ñandú ÀÉÎ œuvre. ǅ ɏ",
    "a1b2 12345 3.14 x=y+z; foo_bar(baz)[0] {k: 'v'} #tag @me $5 100% <p>&amp;</p>",
    "Привет мир. Ελληνικά λέξεις, 中文 文字 日本語 한국어 😀 👩‍💻",
    " leading space and trailing \n",
    "ALLCAPS CamelCase mixed123Case ... --- !!! ,comma .stop a,b a.b",
)

#: White space in the widest sense that is not a single space or line break.
_ODD_SPACE = r"[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters: a run of them is one token of the pre-tokenizer, and a stop or comma after it another.
_LETTERS = r"^[A-Za-zªµºÀ-ÖØ-öø-ɏ]+$"
_MARKED = r"^[A-Za-zªµºÀ-ÖØ-öø-ɏ]+[.,]$"
#: The vocabulary's letter for each byte (the public byte-level scheme): printable Latin-1 as it is, others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Bytes with another letter that lines of Latin words hold.
_IN_WORDS = (10, 32, *range(0x80, 0xA1), 0xAD)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Pieces:
    """The ids of numbered pieces, one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.begins = sizes.cumsum() - sizes

    def take(self, which: np.ndarray) -> Pieces:
        """The pieces of the given numbers, in that order."""
        sizes = self.sizes[which]
        ends = sizes.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.ids)) < 2**31 else np.int64  # the index is the largest array by far
        index = np.repeat((self.begins[which] - (ends - sizes)).astype(kind), sizes)
        index += np.arange(total, dtype=kind)
        return Pieces(self.ids[index], sizes)

    def joined(self, groups: np.ndarray) -> Pieces:
        """Neighbouring pieces made one: groups gives the number of pieces in each."""
        ends = np.concatenate([[0], self.sizes.cumsum()])[np.concatenate([[0], groups.cumsum()])]
        return Pieces(self.ids, np.diff(ends))

    @staticmethod
    def together(*parts: Pieces) -> Pieces:
        return Pieces(np.concatenate([p.ids for p in parts]), np.concatenate([p.sizes for p in parts]))


class TextEncoder:
    def __init__(self, path: str, end_id: int | None = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same model over text that is byte-mapped already: a word to a line, each line break a token
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(_BYTE_CHARS[10], "isolated")
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.marks = self._whole([".", ","])
        self.end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
        nothing = Pieces(np.zeros(0, "<u4"), np.zeros(0, np.int64))
        self.known = {space: (pa.array([], pa.large_string()), nothing) for space in (" ", "")}
        self.by_pieces = True
        self.by_pieces = self.encode(list(PROBE)) == [w.tobytes() + self.end for w in self._library(PROBE)]

    def id_type(self) -> str:
        """The NumPy type that holds every id (and the end id) of the vocabulary."""
        most = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        return "<u2" if max(most, int.from_bytes(self.end, "little")) < 1 << 16 else "<u4"

    def _library(self, texts) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _whole(self, strings: list[str]) -> Pieces:
        """Each string by the library."""
        got = self._library(strings)
        return Pieces(np.concatenate([np.zeros(0, "<u4"), *got]), np.array([len(g) for g in got], dtype=np.int64))

    def _words(self, words: pa.Array, space: str) -> Pieces:
        """Runs of letters, each with space before it; by the library's model."""
        parts = []
        for at in range(0, len(words), 400):
            lines = f"\n{space}" + f"\n{space}".join(words[at : at + 400].to_pylist()) + "\n"
            mapped = lines.encode().decode("latin-1")
            for byte in _IN_WORDS:
                mapped = mapped.replace(chr(byte), _BYTE_CHARS[byte])
            ids = np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype="<u4")
            breaks = np.flatnonzero(ids == self.line)
            parts.append(Pieces(ids[ids != self.line], np.diff(breaks) - 1))
        return Pieces.together(Pieces(np.zeros(0, "<u4"), np.zeros(0, np.int64)), *parts)

    def _distinct(self, pieces: pa.Array, space: str) -> Pieces:
        """Ids of distinct pieces, each with space before it (an empty piece: the space alone)."""
        plain = pc.match_substring_regex(pieces, _LETTERS).to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(pieces, _MARKED).to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(pieces.filter(pa.array(plain | marked)), ".,").dictionary_encode()
        words = self._words(stems.dictionary, space)
        others = self._whole([space + p for p in pieces.filter(pa.array(~(plain | marked))).to_pylist()])
        table, n = Pieces.together(words, others, self.marks), len(words.sizes)
        first = np.zeros(len(pieces), dtype=np.int64)
        first[plain | marked] = stems.indices.to_numpy()
        first[~(plain | marked)] = n + np.arange(len(others.sizes))
        mark = len(table.sizes) - 2 + pc.ends_with(pieces, ",").to_numpy(zero_copy_only=False).astype(np.int64)
        both = np.stack([first, mark], axis=1)[np.stack([np.ones(len(pieces), bool), marked], axis=1)]
        return table.take(both).joined(1 + marked.astype(np.int64))

    def _looked_up(self, pieces: pa.Array, space: str) -> tuple[Pieces, np.ndarray]:
        """Known pieces' ids, and where among them each of the distinct pieces is; new ones are encoded and kept."""
        strings, table = self.known[space]
        at = pc.index_in(pieces, value_set=strings)
        new = pc.is_null(at)
        fresh = pieces.filter(new)
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            where[new.to_numpy(zero_copy_only=False)] = len(strings) + np.arange(len(fresh))
            strings, table = pa.concat_arrays([strings, fresh]), Pieces.together(table, self._distinct(fresh, space))
        if len(strings) <= KNOWN_PIECES:
            self.known[space] = strings, table
        else:  # begin anew with what this group holds
            self.known[space] = (pieces, table.take(where)) if len(pieces) <= KNOWN_PIECES else (strings[:0], table.take(where[:0]))
        return table, where

    def encode(self, texts: pa.Array | list) -> list[bytes]:
        """The ids of each text and the end id, as little-endian uint32; null is an empty text."""
        array = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(array, _ODD_SPACE).to_numpy(zero_copy_only=False) | (not self.by_pieces)
        out: list[bytes] = [b""] * len(array)
        whole = [i for i in np.flatnonzero(odd).tolist()]
        for at in range(0, len(whole), 100):
            part = whole[at : at + 100]
            for i, got in zip(part, self._library([array[i].as_py() for i in part]), strict=True):
                out[i] = got.tobytes() + self.end
        usual = array.filter(pa.array(~odd))
        if not len(usual):
            return out
        lines = pc.split_pattern(usual, "\n")
        line_at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        pieces = pc.split_pattern(lines.flatten(), " ")
        piece_at = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        heads = flat.take(pa.array(piece_at[:-1])).dictionary_encode()  # no space goes before these
        del usual, lines, pieces, flat
        (spaced, spaced_at), (bare, bare_at) = self._looked_up(coded.dictionary, " "), self._looked_up(heads.dictionary, "")
        bare = bare.take(bare_at)
        opened = Pieces(np.array([self.line], dtype="<u4"), np.array([1])).take(np.zeros(len(bare.sizes), np.int64))
        broken = Pieces.together(opened, bare)
        k = len(bare.sizes)
        broken = broken.take(np.stack([np.arange(k), k + np.arange(k)], axis=1).reshape(-1)).joined(np.full(k, 2, np.int64))
        table = Pieces.together(spaced, bare, broken)
        which = spaced_at[coded.indices.to_numpy()]
        later = np.ones(len(piece_at) - 1, dtype=np.int64)  # lines that a line break goes before
        later[line_at[:-1]] = 0
        del coded
        which[piece_at[:-1]] = len(spaced.sizes) + heads.indices.to_numpy() + k * later
        found = table.take(which).joined(np.diff(piece_at[line_at]))
        raw = found.ids.tobytes()
        for i, a, n in zip(np.flatnonzero(~odd).tolist(), (4 * found.begins).tolist(), (4 * found.sizes).tolist(), strict=True):
            out[i] = raw[a : a + n] + self.end
        return out


def grouped(batches: Iterator[pa.RecordBatch], column: int, most: int = GROUP_BYTES, also: int | None = None) -> Iterator[tuple]:
    """The first column's values and the texts (and column also) of some batches at a time, about most bytes of text together."""
    ids: list = []
    texts: list[pa.Array] = []
    more: list[pa.Array] = []
    held = 0

    def group() -> tuple:
        return (ids, pa.concat_arrays(texts)) if also is None else (ids, pa.concat_arrays(texts), pa.concat_arrays(more))

    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts.append(batch.column(column).cast(pa.large_string()))
        more.append(batch.column(also or 0))
        held += texts[-1].nbytes
        if held >= most:
            yield group()
            ids, texts, more, held = [], [], [], 0
            pa.default_memory_pool().release_unused()
    if texts:
        yield group()


def give_back() -> None:
    """Returns freed memory to the system; the C library keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_ENCODERS: dict[str, TextEncoder] = {}


def worker_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encoded_groups(batches: Iterator[pa.RecordBatch], path: str, most: int = GROUP_BYTES, also: int | None = None) -> Iterator[tuple]:
    """What grouped() yields of (id, text) batches, with each text's ids (little-endian uint32, the end id last) for the text."""
    try:
        for ids, texts, *more in grouped(batches, 1, most, also):
            yield ids, worker_encoder(path).encode(texts), *more
    finally:
        give_back()
