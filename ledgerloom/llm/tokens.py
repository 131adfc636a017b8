"""Encoding of whole texts with a public tokenizer, a worker's cache of words, and files written by tasks."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers.
CACHED = 800_000
#: White space before a blank or a newline; and where a text with such may be cut.
_OPEN, _BORDER = re.compile(r"\s[ \n]"), re.compile(r"(?<=\S)(?=[ \n])")
#: A word of letters alone, a newline before it or not; letters that any edition of Unicode since 5 has.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN, _LETTER = re.compile(f"\n?[{_LETTERS}]+"), re.compile(f"[{_LETTERS}]")
#: Marks that may follow a word; neither letters, digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"
#: The character that stands for a byte in a byte-level vocabulary, where it isn't the byte's own.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_BLANK, _NEWLINE = chr(_BYTES[32]), chr(_BYTES[10])


def public_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, as little-endian 16 or 32 bit integers.

    The byte-level pre-tokenizer always begins a piece at a blank or a newline that follows a character other than white
    space, and at a mark that follows a letter. So texts are cut there, and each different word is encoded once. A word
    is kept without its blank, and with its newline; one whose blank is followed by white space is kept with it. The ids
    are those of encoding the whole text. With another pre-tokenizer, or a normalizer, whole texts are encoded."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_path(name))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()
        before = self.tokenizer.pre_tokenizer
        kind = json.loads(before.__getstate__()) if before is not None else {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a blank
        self.opens[[i for t, i in vocabulary.items() if t.startswith(_BLANK)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        #: The number of each word known, and of each end of words (in a tuple); ids of all, in order, and where each one's end.
        self.number: dict[str | tuple[str], int] = {}
        self.ids, self.ends = np.empty(1 << 16, dtype=self.dtype), np.zeros(1 << 14, dtype=np.int64)

    def _keep(self, words: list, ids, starts) -> None:
        """``words``, new ones, begin at ``starts`` among ``ids``."""
        n, more = len(self.number), len(words)
        if not more:
            return
        held = int(self.ends[n])
        while held + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while n + more >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        self.ids[held:held + len(ids)] = ids
        self.ends[n + 1:n + more] = np.asarray(starts[1:]) + held
        self.ends[n + more] = held + len(ids)
        self.number.update(zip(words, range(n, n + more), strict=True))

    def _keep_each(self, words: list, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self._keep(words, list(chain.from_iterable(ids)), np.cumsum([0, *map(len, ids)])[:-1])

    def _numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers one after another, and where each word's end."""
        size = self.ends[numbers + 1] - self.ends[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.ends[numbers + 1] - ends, size) + np.arange(size.sum())], ends

    def _letters(self, words: list[str]) -> None:
        """Words of letters are one piece each, so the model alone encodes them."""
        split, ids, starts = self.tokenizer.model.tokenize, [], []
        newline = [t.id for t in split(_NEWLINE)]
        for w in words:
            starts.append(len(ids))
            raw = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
            if w[0] == "\n":
                ids += newline
                raw = raw[1:]
            else:
                raw = _BLANK + raw
            ids += [t.id for t in split(raw)]
        self._keep(words, ids, starts)

    def _others(self, words: list[str]) -> None:
        """Words after a blank go many as one text: an id that begins with a blank begins a word."""
        if len(words) > 1 and all(w.split() == [w] and "<" not in w for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(words) and at[0] == 0:
                self._keep(words, ids, at.tolist())
                return
        self._keep_each(words, [w if w[:1] in (" ", "\n") else " " + w for w in words])

    def _learn(self, new: set[str]) -> None:
        ended = {}  # words with marks after a letter: the word without them
        for w in new:
            body = w.rstrip(_MARKS)
            if len(body) < len(w) and "<" not in w and body and _LETTER.match(body[-1]):
                ended[w] = body
        need = new.difference(ended).union(ended.values()).difference(self.number)
        self._letters([w for w in need if _PLAIN.fullmatch(w)])
        need = need.difference(self.number)
        odd = [w for w in need if "<" in w or w.split() != [w]]
        for some in (odd, list(need.difference(odd))):
            for at in range(0, len(some), 5_000):
                self._others(some[at:at + 5_000])
        tails = [(w[len(body):],) for w, body in ended.items()]
        fresh = list(set(tails).difference(self.number))
        self._keep_each(fresh, [t for t, in fresh])
        if ended:
            parts = np.stack([self._numbers(list(ended.values())), self._numbers(tails)], axis=1).ravel()
            ids, ends = self._gather(parts)
            self._keep(list(ended), ids, np.concatenate([[0], ends[1:-1:2]]))

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The words of a text in which white space comes before a blank or a newline."""
        first, *rest = _BORDER.split(text)
        return [first, *(p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p for p in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(texts)
        firsts, easy, hard = [], [], []  # of each text: its first word, and the others as a text to be split or as a list
        for t in texts:
            if _OPEN.search(t):
                first, *rest = self._cut(t)
                easy.append(None)
                hard.append(rest)
            else:
                first, more, rest = t.replace("\n", " \n").partition(" ")
                easy.append(rest if more else None)
                hard.append([])
            firsts.append(first)
        if len(self.number) > CACHED:
            self._forget()
        some = pc.split_pattern(pa.array(easy, pa.large_string()), " ")
        n = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = [some.flatten()]
        if any(hard):  # after the easy ones, each text's in one stretch
            values.append(pa.array(chain.from_iterable(hard), pa.large_string()))
        words = pa.concat_arrays([v.cast(pa.large_string()) for v in values]).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(different).difference(self.number))
        numbers = self._numbers(different)[words.indices.to_numpy()]
        start = np.cumsum(n) - n
        longer = np.array(list(map(len, hard)), dtype=np.int64)
        start = np.where(longer > 0, n.sum() + np.cumsum(longer) - longer, start)
        n = n + longer
        parts, ends, held = [], [np.zeros(1, dtype=np.int64)], 0
        for at in range(0, len(numbers), 1 << 18):
            ids, end = self._gather(numbers[at:at + (1 << 18)])
            parts.append(ids.tobytes())
            ends.append(end + held)
            held += len(ids)
        whole, ends = b"".join(parts), np.concatenate(ends) * self.dtype.itemsize
        return [first + whole[a:b] for first, a, b in zip(self._encode(firsts), ends[start].tolist(), ends[start + n].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


def chunks(texts, chars: int = 1 << 22):
    """Lists of texts of about ``chars`` characters, to bound what is held at one time."""
    part, held = [], 0
    for t in texts:
        part.append(t or "")
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def write_file(folder: str, name: str, data) -> None:
    """A whole file in a shared folder: written under another name first, then moved."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/_{name}") as f:
        f.write(data)
    system.move(f"{path}/_{name}", f"{path}/{name}")


def read_range(folder: str, name: str, start: int, length: int) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read_at(length, start)


def as_uri(path: str) -> str:
    """A folder's URI as pyarrow takes it."""
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
