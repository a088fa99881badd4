"""Texts as units that a tokenizer treats independently, and a bounded cache of each unit's ids.

A unit is what lies between single spaces or line ends. A space before a word belongs to it
(" word"), a line end opens the unit that follows it ("\\nword"). Neither vocabulary merges
across such a border: a token that holds a visible character never holds white space behind
it, and white space before the last of a run stands alone. Texts with other white space are
cut only at single spaces between two visible characters, where the same holds.

Splitting and counting distinct units is done by Arrow's kernels for a whole batch of texts;
Python sees each distinct unit of a batch once.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import string
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x00]|  |\\n\\n| \\n|\\n "

_OPEN, _NONE, _SPACE = (pa.scalar(s, pa.large_string()) for s in ("\n\n", "", "\0"))

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Marks that may stand behind a word; those of special tokens and contractions are not among them.
_STOPS = "".join(c for c in string.punctuation if c not in "'<>|")
_STOPPED = f"[{_LETTERS}][{re.escape(_STOPS)}]+$"
_LATIN = re.compile(f"[ \\n][{_LETTERS}]+").fullmatch
_LATIN_UNIT = f"\\A[ \\n][{_LETTERS}]+\\z"
_LATIN_KEY = f"\\A\\n{{0,2}}[{_LETTERS}]+\\z"

#: Distinct words that a worker keeps ids of; the cache starts anew beyond it.
MAX_WORDS = 300_000
MAX_STOPS = 10_000


def split_units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Keys of the units of all texts, joined, and the number of units of each text.

    A key that opens a text starts with \\x00 and has no space before it, one that starts with a
    line end has none either; all others have one (see :func:`unit_text`).
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, _ODD_SPACE)
    plain = pc.if_else(odd, _NONE, texts) if pc.any(odd).as_py() else texts
    plain = pc.replace_substring(plain, "\n", " \n")
    parts = pc.split_pattern(pc.binary_join_element_wise(_OPEN, plain, _NONE), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(rows):
        ends = np.cumsum(counts)
        pieces, last = [], 0
        for row in rows.tolist():
            keys = _SAFE_SPACE.split(texts[row].as_py())
            keys[0] = "\n\n" + keys[0]
            pieces += [flat.slice(last, ends[row] - 1 - last), pa.array(keys, pa.large_string())]
            last = ends[row]
            counts[row] = len(keys)
        flat = pa.concat_arrays([*pieces, flat.slice(last)])
    return flat.dictionary_encode(), counts


def unit_text(key: str) -> str:
    if key[:2] == "\n\n":
        return key[2:]
    return key if key[:1] == "\n" else " " + key


class UnitEncoder:
    """Ids of whole texts from the ids of their units, as little-endian unsigned 16-bit integers.

    ``encode_units`` gets unit texts and returns the bytes of each unit's ids. A unit that is a
    word with stops behind it is two: both vocabularies cut there, so the word's ids serve with
    and without its stops. With ``fold``, for vocabularies of lower-case words without the white
    space around them, a word of Latin letters is one in upper and lower case and wherever it stands.
    """

    def __init__(self, encode_units: Callable[[list[str]], list[bytes]], fold: bool = False):
        self.encode_units = encode_units
        self.fold = fold
        self.words: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _stop(self, mark: str) -> bytes:
        if mark not in self.stops:
            alone, with_mark = self.encode_units(["x", "x" + mark])
            self.stops[mark] = with_mark.removeprefix(alone)
        return self.stops[mark]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The bytes of the ids of each text."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self.stops) > MAX_STOPS:
            self.stops.clear()
        units, n_units = split_units(texts)
        keys = units.dictionary
        marked = pc.match_substring_regex(keys, _STOPPED)
        bare = pc.if_else(marked, pc.utf8_rtrim(keys, _STOPS), keys)
        if self.fold:
            bare = pc.if_else(pc.match_substring_regex(bare, _LATIN_KEY), pc.utf8_lower(pc.utf8_ltrim(bare, "\n")), bare)
        bare = bare.dictionary_encode()
        words = strings(bare.dictionary)
        of_word = list(map(self.words.get, words))
        unseen = [i for i, ids in enumerate(of_word) if ids is None]
        new = [words[i] for i in unseen]
        for i, word, ids in zip(unseen, new, self.encode_units(list(map(unit_text, new))), strict=True):
            of_word[i] = self.words[word] = ids
        # words with stops behind them come after the words
        stopped, at = np.flatnonzero(marked), bare.indices.to_numpy().copy()
        for i, key in zip(at[stopped].tolist(), strings(keys.filter(marked)), strict=True):
            of_word.append(of_word[i] + self._stop(key[len(key.rstrip(_STOPS)) :]))
        at[stopped] = np.arange(len(words), len(of_word))
        flat = pa.array(of_word, pa.large_binary()).take(pa.array(at[units.indices.to_numpy()]))
        if not flat.nbytes or flat.buffers()[2] is None:
            return [b""] * len(n_units)
        borders = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset :][np.cumsum([0, *n_units])].tolist()
        raw = memoryview(flat.buffers()[2])
        return [raw[a:b].tobytes() for a, b in itertools.pairwise(borders)]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def tokenizer_path(name: str) -> str:
    """A path as given, or the file of that name in the installed vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, UnitEncoder] = {}
_TOGETHER = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters
    stand for themselves, the other bytes for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def library_encoder(name: str) -> UnitEncoder:
    """The tokenizers library behind a unit cache, one for each Python worker and vocabulary.

    Units that are one word of Latin letters are one piece for either vocabulary. They are
    spelled in the vocabulary's byte letters and go in long strings through the same model
    behind a pre-tokenizer that only cuts at spaces, which spares the library its work on
    each character; a string whose words can't be told apart in the result is encoded word
    by word. All other units go through the tokenizer as it is. Ids must be below 65,536.
    """
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        whole, model = (Tokenizer.from_file(tokenizer_path(name)) for _ in range(2))
        for tok in (whole, model):
            tok.no_truncation()
            tok.no_padding()
        model.normalizer = normalizers.Sequence([])
        model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = whole.get_vocab(with_added_tokens=False)
        size = whole.get_vocab_size()
        if size > 0x10000:
            raise ValueError("vocabularies over 65,536 ids are not supported")
        word_ends = any(t.endswith("</w>") for t in vocab)
        letters = byte_letters()
        spell = letters.__getitem__
        # what each id adds to a running sum: letters, or ends of words
        weight = np.full(size, 1 << 40, np.int64)
        for token, i in vocab.items():
            weight[i] = token.endswith("</w>") if word_ends else len(token)
        line_end = b"" if word_ends else vocab[letters[0x0A]].to_bytes(2, "little")

        # bytes of words to letters; the space cuts words and \x00 stands for the one that belongs to a word
        spelling = "".join(letters[0x20] if b == 0 else " " if b == 0x20 else c for b, c in enumerate(letters))

        def spelled(words: list[str]) -> str:
            return codecs.charmap_decode(" ".join(words).encode(), "strict", spelling)[0]

        def one_by_one(tok: Tokenizer, units: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u2").tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]

        def encode_words(words: list[str], lengths: np.ndarray) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(words), 64 * _TOGETHER):
                starts = range(at, min(len(words), at + 64 * _TOGETHER), _TOGETHER)
                joined = model.encode_batch_fast([spelled(words[i : i + _TOGETHER]) for i in starts], add_special_tokens=False)
                for start, e in zip(starts, joined, strict=True):
                    got = np.array(e.ids, "<u2")
                    so_far = np.cumsum(weight[got])
                    due = np.cumsum(lengths[start : start + _TOGETHER])
                    cuts = np.searchsorted(so_far, due) + 1
                    if so_far[-1] == due[-1] and (so_far[cuts - 1] == due).all():
                        raw, ends = got.tobytes(), (2 * cuts).tolist()
                        out += [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
                    else:
                        out += one_by_one(model, [spelled([w]) for w in words[start : start + _TOGETHER]])
            return out

        def encode_units(units: list[str]) -> list[bytes]:
            out: list[bytes] = [b""] * len(units)
            column = pa.array(units, pa.large_string())
            latin = pc.match_substring_regex(column, _LATIN_UNIT)
            easy, rest = (np.flatnonzero(m.to_numpy(zero_copy_only=False)).tolist() for m in (latin, pc.invert(latin)))
            column = column.filter(latin)
            words = pc.utf8_slice_codeunits(column, 1)
            if word_ends:
                words = pc.utf8_lower(words)
            else:
                words = pc.binary_join_element_wise(pc.if_else(pc.starts_with(column, "\n"), _NONE, _SPACE), words, _NONE)
            lengths = np.ones(len(words), np.int64) if word_ends else pc.binary_length(words).to_numpy()
            for i, ids in zip(easy, encode_words(strings(words), lengths), strict=True):
                out[i] = line_end + ids if line_end and units[i][0] == "\n" else ids
            for at in range(0, len(rest), 4096):
                some = rest[at : at + 4096]
                for i, ids in zip(some, one_by_one(whole, [units[i] for i in some]), strict=True):
                    out[i] = ids
            return out

        _LOADED[name] = UnitEncoder(encode_units, fold=word_ends)
    return _LOADED[name]


def as_array(texts: Iterable[str | None]) -> pa.Array:
    return pa.array(list(texts), pa.large_string())
