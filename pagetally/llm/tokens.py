"""Token counts from a compiled finite-state tokenizer.

``compile_tokenizer`` turns a byte-level BPE vocabulary file into two machines:

* the *segmenter*, a deterministic transducer over bytes with eight states. Each transition says
  whether a new pre-token begins there. A batch of texts is one byte stream; it is cut into equal
  chunks, every chunk's map from entry state to exit state is worked out for all chunks at once,
  the maps are composed by a parallel prefix scan, and a last pass with the known entry states
  emits the boundaries. A text of any length therefore costs its bytes and no more.
* the *word machine*, a deterministic transducer over the bytes of a pre-token, whose transitions are
  annotated with token counts. In byte-pair encoding a token sequence is the encoding of its bytes if
  and only if each two neighbours are (``apart``), so the encoding of every beginning of a word is the
  encoding of a shorter beginning and one more token, and which token that is depends on the last
  tokens of the beginnings before it. A state is the longest end of what was read that begins some
  token, with the last token and the relative count of the beginnings inside it: all that later
  tokens can reach back to. So there are finitely many states, whatever the length of a word. A
  transition's annotation is by how much the encoding grows. Transitions are compiled when they are
  first taken; beyond ``STATES_KEPT`` states the machine is begun anew, which bounds its memory.

A document's count is the sum of the annotations its path takes. (``encode``, which gives the ids that packing
needs, merges the distinct pre-tokens of a batch in rank order, all at once.)

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text
count as the special token; a text of any length, and a word of any length, is counted whole; rows are independent, so ties, repeated rows and any number of
further columns do not matter (only ``id_col`` and ``text_col`` are read); an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import blobs, tune

# Input symbols of the segmenter.
(LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_IN, BLANK_LAST, SPACE_LAST, CONT, END, SPECIAL) = range(11)
SYMBOLS = 11
# States: what the current pre-token is made of so far.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, NEED1, NEED2) = range(8)
STATES = 8
CHUNK = 128
SEPARATOR = 0xFF  # never occurs in UTF-8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state x SYMBOLS, emits) for state * SYMBOLS + symbol."""
    to = np.zeros((STATES, SYMBOLS), np.uint8)
    emit = np.ones((STATES, SYMBOLS), np.uint8)
    for state in range(STATES):
        for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
            to[state, symbol] = inside
            emit[state, symbol] = state not in (inside, AFTER_BLANK)
        for symbol, need in ((QUOTE1, NEED1), (QUOTE2, NEED2)):
            joins = state in (IN_OTHER, AFTER_BLANK)
            to[state, symbol] = IN_OTHER if joins else need
            emit[state, symbol] = not joins
        to[state, SPACE_IN] = IN_SPACE
        emit[state, SPACE_IN] = state != IN_SPACE
        to[state, BLANK_LAST] = AFTER_BLANK
        to[state, SPACE_LAST] = FRESH
        to[state, CONT] = state
        emit[state, CONT] = 0
        to[state, END] = to[state, SPECIAL] = FRESH
    for state, after in ((NEED2, NEED1), (NEED1, FRESH)):  # the letters of a contraction
        to[state, LETTER], emit[state, LETTER] = after, 0
    return (to * SYMBOLS).ravel(), emit.ravel()


NEXT, EMIT = _machine()


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(path: str) -> np.ndarray:
    """Class of every code point, as the library itself splits it: a letter joins "a" before it,
    a number joins "1", whatever neither joins "!" is a space, and the rest is other."""
    from tokenizers import Tokenizer as Library

    kind = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Co", "Cn")], np.int64)
    split = Library.from_file(path).pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in points]
    for before, name in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        starts = {begin for _, (begin, _) in split("".join([f"\n{before}{c}" for c in chars]))}
        joins = np.array([3 * i + 2 not in starts for i in range(len(chars))])
        if name == OTHER:
            rest = points[~joins]
            kind[rest[kind[rest] == OTHER]] = SPACE_IN
        else:
            kind[points[joins]] = name
    return kind


@lru_cache(maxsize=2)
def packed_classes(path: str) -> bytes:
    """The class table for the workers: worked out once, on the driver; a few kilobytes."""
    return zlib.compress(character_classes(path).tobytes(), 9)


class Tokenizer:
    """The compiled machines. Its size is bounded by the vocabulary and the cache limit."""

    CACHE = 200_000  # transitions kept; beyond it the word machine starts anew

    def __init__(self, path: str, classes: bytes | None = None):
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space or normalizer is compiled")
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self._hash_pairs(left << 20 | right, np.array([vocab[a + b] for a, b in merges], np.int64))
        self.classes = np.frombuffer(zlib.decompress(classes or packed_classes(path)), np.uint8)
        self.rank = {(int(a), int(b)): (k, int(c)) for k, (a, b, c) in enumerate(zip(left, right, (vocab[x + y] for x, y in merges), strict=True))}
        self.bytes_of = {i: bytes(alphabet[ch] for ch in t) for t, i in vocab.items() if all(ch in alphabet for ch in t)}
        self.word_machine: WordMachine | None = None
        self.words: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.words.clear()
        self.n = np.zeros(1 << 12, np.int32)  # ids of each transition
        self.at = np.zeros(1 << 12, np.int64)  # where they begin in flat
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    # -- compilation -----------------------------------------------------------------------
    def _hash_pairs(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: slot -> (pair, rank << 20 | made id)."""
        self.bits = 18
        size = 1 << self.bits
        self.slot_key = np.full(size + 64, -1, np.int64)
        self.slot_val = np.full(size + 64, 1 << 62, np.int64)
        value = (np.arange(len(keys), dtype=np.int64) << 20) | made
        rest, depth = np.arange(len(keys)), 0
        while len(rest):
            slot = self._slot(keys[rest]) + depth
            free = self.slot_key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            take = first[free[first]]
            self.slot_key[slot[take]], self.slot_val[slot[take]] = keys[rest[take]], value[rest[take]]
            rest = np.delete(rest, take)
            depth += 1
        self.depth = depth

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _value(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_val[slot], 1 << 62)
        for d in range(1, self.depth):
            hit = np.flatnonzero(self.slot_key[slot + d] == keys)
            out[hit] = self.slot_val[slot[hit] + d]
        return out

    # -- segmentation ----------------------------------------------------------------------
    def symbols(self, data: np.ndarray) -> np.ndarray:
        ascii_class = self.classes[:256].copy()
        ascii_class[0x80:] = CONT
        ascii_class[SEPARATOR] = END
        sym = ascii_class[data]
        width = None
        lead = np.flatnonzero((data >= 0xC0) & (data != SEPARATOR))
        if len(lead):
            b0 = data[lead].astype(np.int64)
            pad = np.concatenate([data, np.zeros(4, np.uint8)])
            b1, b2, b3 = (pad[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
            point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
            sym[lead] = self.classes[np.minimum(point, 0x10FFFF)]
            width = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        if self.special_re is not None:
            for m in self.special_re.finditer(data):
                sym[m.start()] = SPECIAL
                sym[m.start() + 1 : m.end()] = CONT
        blank = np.flatnonzero(sym == SPACE_IN)
        after = blank + 1
        if width is not None:
            wide = np.ones(len(data), np.uint8)
            wide[lead] = width
            after = blank + wide[blank]
        follows = sym[np.minimum(after, len(sym) - 1)]
        last = ~np.isin(follows, (SPACE_IN, END, SPECIAL))
        last_at = blank[last]
        sym[last_at] = np.where(data[last_at] == 0x20, BLANK_LAST, SPACE_LAST)
        quote = np.flatnonzero(data[:-2] == 0x27) if len(data) > 2 else np.zeros(0, np.int64)
        quote = quote[sym[quote] == OTHER]
        if len(quote):
            x, y = data[quote + 1], data[quote + 2]
            sym[quote[np.isin(x, np.frombuffer(b"stmd", np.uint8))]] = QUOTE1
            two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
            sym[quote[two]] = QUOTE2
        return sym

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Byte positions at which pre-tokens begin (each separator is a piece of its own)."""
        n = len(data)
        chunks = -(-n // CHUNK)
        sym = np.full(chunks * CHUNK, END, np.uint8)
        sym[:n] = self.symbols(data)
        columns = np.ascontiguousarray(sym.reshape(chunks, CHUNK).T)
        # Every chunk's state map: all entry states side by side.
        state = np.repeat((np.arange(STATES, dtype=np.uint8) * SYMBOLS)[:, None], chunks, 1)
        for column in columns:
            state = NEXT[state + column]
        maps = (state // SYMBOLS).T.copy()  # chunk x entry state -> exit state
        # Inclusive prefix scan: after it, maps[c] leads from the stream's start through chunk c.
        step = 1
        while step < chunks:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), 1)
            step *= 2
        entry = np.zeros(chunks, np.uint8)
        entry[1:] = maps[:-1, FRESH] * SYMBOLS
        out = np.empty((CHUNK, chunks), np.uint8)
        for j, column in enumerate(columns):
            at = entry + column
            out[j] = EMIT[at]
            entry = NEXT[at]
        return np.flatnonzero(out.T.ravel()[:n])

    # -- words -----------------------------------------------------------------------------
    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number for each), by merging in rank order."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lens)
        done_ids, done_owner = [], []
        none = 1 << 62
        value = np.full(len(ids), none, np.int64)
        same = owner[:-1] == owner[1:]
        at = np.flatnonzero(same)
        value[at] = self._value(ids[at] << 20 | ids[at + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(value, first)
            size = np.diff(np.r_[first, len(ids)])
            live = best < none
            if not live.all():
                over = np.repeat(~live, size)
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, value = ids[~over], owner[~over], value[~over]
                best, size = best[live], size[live]
                if not len(ids):
                    break
            hit = value == np.repeat(best, size)
            run = np.flatnonzero(hit)
            if len(run) > 1:  # of a run such as "aaa" every second pair is merged, from the left
                new = np.r_[True, run[1:] != run[:-1] + 1]
                begin = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - begin) % 2 == 0]
            ids[run] = value[run] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[run + 1] = False
            mark = np.zeros(len(ids), bool)
            mark[run] = True
            ids, owner, value, mark = ids[keep], owner[keep], value[keep], mark[keep]
            mark[:-1] |= mark[1:]  # the pairs that a merged id ends or begins
            touched = np.flatnonzero(mark)
            inner = touched[touched < len(ids) - 1]
            inner = inner[owner[inner] == owner[inner + 1]]
            value[touched] = none
            value[inner] = self._value(ids[inner] << 20 | ids[inner + 1])
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(pieces)).astype(np.int32)

    def _learn(self, pieces: list[bytes]) -> None:
        ids, n = self._merge(pieces)
        base, k = len(self.words), len(pieces)
        while base + k > len(self.n):
            self.n, self.at = np.resize(self.n, 2 * len(self.n)), np.resize(self.at, 2 * len(self.at))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.n[base : base + k] = n
        self.at[base : base + k] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.words.update(zip(pieces, range(base, base + k), strict=True))

    def transitions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each piece, its transition). A separator's transition emits id 0."""
        starts = self.boundaries(data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        if len(self.words) > self.CACHE:
            self._reset()
        distinct = coded.dictionary.to_pylist()
        find = self.words.get
        at = [find(p, -1) for p in distinct]
        new = [p for p, k in zip(distinct, at, strict=True) if k < 0]
        if new:
            mark = bytes([SEPARATOR])
            fixed = {mark: 0} | self.special
            whole = [p for p in new if p in fixed]
            self._learn([p for p in new if p not in fixed] or [b" "])
            for p in whole:
                base = len(self.words)
                if base + 1 > len(self.n):
                    self.n, self.at = np.resize(self.n, 2 * len(self.n)), np.resize(self.at, 2 * len(self.at))
                if self.used + 1 > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.n[base], self.at[base], self.flat[self.used] = 1, self.used, fixed[p]
                self.used += 1
                self.words[p] = base
            at = [find(p) for p in distinct]
        return starts, np.array(at, np.int64)[coded.indices.to_numpy()]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with a 0 after each document, where each document's ids end).
        data: the texts, each followed by a separator; ends: the separators' places."""
        starts, word = self.transitions(data)
        n = self.n[word].astype(np.int64)
        total = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[word] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        return ids, total[np.searchsorted(starts, ends)]

    def count(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each text, without separators."""
        if self.word_machine is None:
            self.word_machine = WordMachine(self)
        starts = self.boundaries(data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()  # equal words take equal paths
        each = np.array(self.word_machine.count(coded.dictionary.to_pylist()), np.int64)
        total = np.cumsum(each[coded.indices.to_numpy()])[np.searchsorted(starts, ends)]
        return np.diff(total, prepend=0) - 1


class WordMachine:
    """The lazily compiled transducer; see the module's docstring."""

    STATES_KEPT = 200_000
    WORDS_KEPT = 400_000  # of their counts

    def __init__(self, tokenizer: Tokenizer):
        self.rank, self.bytes_of = tokenizer.rank, tokenizer.bytes_of
        self.byte_id = tokenizer.byte_id.tolist()
        self.fixed = {bytes([SEPARATOR]): 1} | dict.fromkeys(tokenizer.special, 1)
        special = set(tokenizer.special.values())
        # tokens that merging can make; others never end a word's beginning
        self.split: dict[int, tuple[int, int, int]] = {}  # rank of a token's last merge, and what it merges
        self.token = {}
        for i, b in self.bytes_of.items():
            if i not in special and self.merged(b, i) == [i]:
                self.token[b] = i
        born = lambda i: self.split[i][0] if i in self.split else -1
        # what a merge joins was made by earlier merges, so pairs are merged in the order of their ranks
        if not all(max(born(a), born(b)) < rank for rank, a, b in self.split.values()):
            raise ValueError("only vocabularies whose merges come after those of their parts are compiled")
        self.begins = {b[:k] for b in self.token for k in range(1, len(b) + 1)}
        self.edges: list[dict[int, list]] = [{}, {}]
        self.known: dict[bytes, int] = dict(self.fixed)
        self.reset()

    def reset(self) -> None:
        self.states = [(b"", (-1,), (0,))]  # end of what was read, last tokens and counts of the beginnings inside it
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}  # state << 8 | byte -> (state, tokens more)
        self.side_by_side: dict[int, bool] = {}

    def merged(self, text: bytes, of: int) -> list[int]:
        """Byte-pair merging by rank, of the leftmost of equal pairs; the last merge is kept as the split of ``of``."""
        ids = [self.byte_id[b] for b in text]
        while len(ids) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
            if not found:
                break
            rank, i = min(found)
            if len(ids) == 2:
                self.split[of] = rank, ids[0], ids[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at a token's left (0) or right (1) end while it is merged: (id, made at rank, used at rank)."""
        out = self.edges[side].get(token)
        if out is None:
            out, part, used = [], token, 1 << 60
            while True:
                rank, *parts = self.split.get(part, (-1, None, None))
                out.append((part, rank, used))
                if rank < 0:
                    break
                part, used = parts[side], rank
            self.edges[side][token] = out
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes; a = -1 is a word's beginning. They are
        unless some merge joins both while it is its turn: of pairs of equal rank the left one comes first."""
        if a < 0:
            return True
        out = self.side_by_side.get(a << 20 | b)
        if out is None:
            get = self.rank.get
            out = self.side_by_side[a << 20 | b] = not any(
                (pair := get((x, y))) is not None and made < pair[0] < used and also_made < pair[0] <= also_used for x, made, used in self.edge(a, 1) for y, also_made, also_used in self.edge(b, 0)
            )
        return out

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        end, last, count = self.states[state]
        end += bytes([byte])
        # positions of the beginnings: last[k] belongs to the one that ends k bytes into ``end``
        get = self.token.get
        for k in range(len(end)):
            token = get(end[k:])
            if token is not None and self.apart(last[k], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        more = count[k] + 1
        last, count = (*last, token), (*(c - more for c in count), 0)
        cut = 0
        while cut < len(end) and end[cut:] not in self.begins:
            cut += 1
        key = (end[cut:], last[cut:], count[cut:]) if cut else (end, last, count)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.next[state << 8 | byte] = to, more
        return to, more

    def count(self, words: list[bytes]) -> list[int]:
        if len(self.states) > self.STATES_KEPT:
            self.reset()
        if len(self.known) > self.WORDS_KEPT:
            self.known = dict(self.fixed)
        out = []
        for word in words:
            n = self.known.get(word)
            if n is None:
                state = n = 0
                take = self.next.get
                for byte in word:
                    state, more = take(state << 8 | byte) or self.compile(state, byte)
                    n += more
                    if len(self.states) > 2 * self.STATES_KEPT:  # within one very long word, too
                        key, held = self.states[state], n
                        self.reset()
                        take = self.next.get
                        state = self.number.setdefault(key, len(self.states))
                        if state == len(self.states):
                            self.states.append(key)
                        n = held
                if len(word) <= 64:
                    self.known[word] = n
            out.append(n)
        return out


@lru_cache(maxsize=2)
def compile_tokenizer(path: str, classes: bytes | None = None) -> Tokenizer:
    return Tokenizer(path, classes)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row; one pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    tune(docs.sparkSession)
    classes = packed_classes(tokenizer_path)

    def run(batches):
        machine = compile_tokenizer(tokenizer_path, classes)
        for ids, data, ends in blobs(batches, SEPARATOR):
            size = np.diff(ends, prepend=-1) - 1
            n = machine.count(data, ends)
            yield pa.record_batch([ids, pa.array(size.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
