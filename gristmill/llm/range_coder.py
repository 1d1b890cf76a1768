"""Token ids in files, by an adaptive context-mixing range coder.

A segment is a run of whole documents; its ids are cut into blocks that are coded independently, each from a reset state
and with a checksum of its own. Blocks start from the segment's header: how often each id occurs, and which ids follow it over
three times, and how often. So orders 0 and 1 are fixed for a segment. In a block, order 2 keeps the entry that followed each
context last and how often in a row; how far it is trusted is learned as coding goes. The mixed distribution drives a 64-bit
range coder.

All blocks of a segment advance together, one numpy lane each, so the coder's cost is some hundred vector operations an id of
each lane.

Files: Parquet rows of one segment each: part and segment (their order is that of the ids), n_ids, ids and lengths of its
documents, and payload: magic, ids a block, blocks, different ids, size and CRC-32 of the header; then of each block its
size in bytes and CRC-32 of its ids; then the header and the blocks. What does not match its checksum raises.

Defined cases: null and empty texts are the end id alone; null document ids come first; equal ids in any order; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import Scratch, partitions
from ._text import slices
from .byte_bpe import take_ranges

_MAGIC = b"CMR3"
_SCALE = 20  # bits of the mixture
_REST = 24  # bits of order 0
_LEAST = 32  # of 2**_SCALE, what a follower has at least, so that no weight makes it nothing
_FOLLOWERS = 4096  # of one id at most
_PLACES = 12_000_000  # pairs of ranks that are counted by place, not by sorting
_WEIGHT = 10  # bits of a weight
_MOST_TRUST = 0.94  # what is left of _LEAST parts is one at least
_S2 = 128  # slots of order 2 in each lane
_LANES, _LEAST_BLOCK, _MOST_BLOCK = 4096, 512, 1 << 16
_U = np.uint64


class _Prior:
    """What every block of a segment starts from, kept in the segment's header: the ids that occur with their counts, and
    for each id the ids that follow it over three times, with their counts. From it come the shares of orders 0 and 1.

    Followers are entries (context, rank, start, width) in order of context; each context's last entry is its rest, which
    order 0 shares out by the counts that no follower has taken. Entry 0 is nobody's. Context n is a block's start."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, blocks: int, many: np.ndarray, ranks: np.ndarray, pairs: np.ndarray):
        self.names, self.counts, self.many, self.ranks, self.pairs = names, counts, many, ranks, pairs
        n = len(names)
        context = np.repeat(np.arange(n + 1), many)
        rest = np.append(counts, blocks) - np.bincount(context, pairs, n + 1).astype(np.int64)
        self.rest = np.cumsum(many + 1)  # the entry of each context's rest
        at = np.arange(len(ranks)) + context + 1
        size = 2 + len(ranks) + n
        self.context, self.rank, weight = np.full(size, -1), np.full(size, n), np.zeros(size, np.int64)
        self.context[at], self.rank[at], weight[at] = context, ranks, pairs
        self.context[self.rest], weight[self.rest] = np.arange(n + 1), np.maximum(rest, 0) + 1
        first = self.rest - many
        all_of = np.add.reduceat(weight, first)
        of = self.context[1:]
        free = (1 << _SCALE) - _LEAST * (many + 1)
        before = np.cumsum(weight[1:]) - weight[1:]
        before -= before[first - 1][of]
        start = before * free[of] // all_of[of] + _LEAST * (np.arange(size - 1) - (first - 1)[of])
        self.start = np.append(0, start)
        self.width = np.append(0, np.append(start[1:], 0) - start)
        self.width[self.rest] = (1 << _SCALE) - self.start[self.rest]
        left = np.maximum(counts - np.bincount(ranks, pairs, n).astype(np.int64), 0)
        upto = np.append(0, np.cumsum(left))
        self.zero = upto * ((1 << _REST) - n) // max(1, int(upto[-1])) + np.arange(n + 1)
        self.zero[-1] = 1 << _REST

    def index(self) -> None:
        """For each context some buckets of its shares, twice to four times as many as entries, with the first entry of each."""
        bits = np.ceil(np.log2(self.many + 1)).astype(np.int64) + 1
        self.shift = (_SCALE - bits).astype(np.int32)
        self.bucket = np.cumsum(1 << bits) - (1 << bits)
        of = np.repeat(np.arange(len(bits)), 1 << bits)
        begin = np.arange(len(of)) - self.bucket[of] << self.shift[of]
        self.holder = (np.searchsorted((self.context << _SCALE) + self.start, (of << _SCALE) + begin, "right") - 1).astype(np.int32)
        self.end = (self.start + self.width).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray, size: int) -> tuple["_Prior", np.ndarray, np.ndarray]:
        """The prior of ids in blocks of `size`, and the rank and entry of each id."""
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        ranks, counts, n = (np.cumsum(counts > 0, dtype=np.int32) - np.int32(1))[ids], counts[names], len(names)
        pair = np.empty(len(ids), np.int64)
        pair[1:] = ranks[:-1]
        pair[::size] = n
        pair *= n
        pair += ranks
        if n * (n + 1) <= _PLACES:
            place, many = None, np.bincount(pair, minlength=n * (n + 1))
            listed = np.flatnonzero(many > 3)
        else:
            held, place, many = np.unique(pair, return_inverse=True, return_counts=True)
            listed = np.flatnonzero(many > 3)
        key, found = listed if place is None else held[listed], many[listed]
        context = key // n
        by = np.lexsort((-found, context))
        order = np.empty(len(key), np.int64)
        order[by] = np.arange(len(key)) - np.searchsorted(context, context)
        stay = order < _FOLLOWERS
        listed, key, found, context = listed[stay], key[stay], found[stay], context[stay]
        prior = cls(names, counts, -(-len(ids) // size), np.bincount(context, minlength=n + 1), key % n, found)
        entries = np.zeros(len(many), np.int32)
        entries[listed] = np.arange(len(key)) + context + 1
        entry = entries[pair if place is None else place]
        other = np.flatnonzero(entry == 0)
        entry[other] = prior.rest[pair[other] // n]
        return prior, ranks, entry

    def tobytes(self) -> bytes:
        start = np.zeros(len(self.ranks), bool)
        start[(np.cumsum(self.many) - self.many)[self.many > 0]] = True
        steps = np.where(start, self.ranks, np.diff(self.ranks, prepend=0))
        parts = [np.diff(self.names, prepend=0), self.counts, self.many, steps, self.pairs]
        raw = b"".join(np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts)
        return np.array([len(self.ranks)], "<u4").tobytes() + zlib.compress(raw, 6)

    @classmethod
    def frombytes(cls, data: bytes, n: int, blocks: int) -> "_Prior":
        listed = int(np.frombuffer(data, "<u4", 1)[0])
        raw, at, out = zlib.decompress(data[4:]), 0, []
        for many in (n, n, n + 1, listed, listed):
            out.append(np.frombuffer(raw, np.uint8, many * 4, at).reshape(4, many).T.copy().view("<u4").reshape(-1).astype(np.int64))
            at += many * 4
        names, counts, many, steps, pairs = out
        upto = np.append(0, np.cumsum(steps))
        return cls(np.cumsum(names), counts, blocks, many, upto[1:] - np.repeat(upto[np.cumsum(many) - many], many), pairs)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values.take(at, mode="clip")  # faster, and no word of damaged blocks is past the end


class _Model:
    """The mixture of all lanes. Encoder and decoder make the same calls in the same order.

    The unit interval is 2**_SCALE parts. Order 2 gives its weight to one entry, the one that followed the two ids last in this
    block; orders 1 and 0 share the rest as the prior says. The entry stands first, with the sum of both; the others follow in
    the prior's order, without it. Weights are learned in the block, one for each length of the row in which an entry was right,
    from how much of what was coded was order 2's."""

    def __init__(self, prior: _Prior, lanes: int):
        self.prior, n = prior, len(prior.names)
        lane = np.arange(lanes)
        self.at_last, self.at_trust = lane * _S2, lane.astype(np.int32) * 16
        self.last = np.zeros(lanes * _S2, np.int32)  # entry << 4 | row
        self.trust = np.tile((0.02 + 0.9 * np.arange(16) / 18).astype(np.float32), lanes)
        self.context, self.start, self.width = (x.astype(np.int32) for x in (prior.context, prior.start, prior.width))
        self.is_rest = prior.rank == n
        self.prev1 = np.full(lanes, n, np.int32)
        self.hash1 = self.hash2 = np.full(lanes, n * 40503)

    def predict(self) -> None:
        slot = self.hash1 + self.hash2
        slot >>= 5
        slot &= _S2 - 1
        slot += self.at_last
        self.slot, self.seen = slot, _take(self.last, slot)
        self.entry = self.seen >> 4
        self.row = self.seen & 15
        at = self.entry.astype(np.int64)
        self.valid = _take(self.context, at) == self.prev1
        self.t_at = self.at_trust + self.row
        self.trusted = _take(self.trust, self.t_at)
        self.part = (self.trusted * np.float32(1 << _WEIGHT)).astype(np.int32)
        self.part *= self.valid
        self.left = (1 << _WEIGHT) - self.part
        self.own = _take(self.width, at) * self.valid
        self.after = _take(self.start, at)
        others = (1 << _SCALE) - self.own
        others *= self.left
        others >>= _WEIGHT
        self.first = (1 << _SCALE) - others

    def place(self, entry: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of entries; at is the same as an index."""
        self.hit = entry == self.entry
        end = _take(self.start, at)
        end -= self.own * (end > self.after)
        start = end * self.left
        start >>= _WEIGHT
        end += _take(self.width, at)
        end *= self.left
        end >>= _WEIGHT
        end -= start
        start += self.first
        start *= ~self.hit
        return start.astype(_U), np.where(self.hit, self.first, end).astype(_U)

    def at(self, v: np.ndarray) -> np.ndarray:
        """The entries whose places hold v."""
        u = v - self.first
        mine = u < 0
        u += 1
        u <<= _WEIGHT
        u -= 1
        u = (u / self.left).astype(np.int32)
        np.maximum(u, 0, out=u)
        u += self.own * (u >= self.after)
        at = u >> _take(self.prior.shift, self.prev1)
        at += _take(self.prior.bucket, self.prev1)
        found = _take(self.prior.holder, at)
        later = np.flatnonzero(_take(self.prior.end, found) <= u)
        where, upto = found[later], u[later]
        while len(later):
            where += 1
            found[later] = where
            on = self.prior.end[where] <= upto
            later, where, upto = later[on], where[on], upto[on]
        return np.where(mine, self.entry, found)

    def update(self, x: np.ndarray, entry: np.ndarray, missed: np.ndarray) -> None:
        right = (self.part * self.hit).astype(np.float32)
        right *= np.float32(_MOST_TRUST * (1 << (_SCALE - _WEIGHT)))
        right /= np.maximum(self.first, 1).astype(np.float32)
        right -= self.trusted
        right *= np.float32(0.04)
        right *= self.valid
        right += self.trusted
        self.trust[self.t_at] = right
        new = entry << 4
        new |= 1
        new[missed] = 0
        kept = np.where(self.hit, self.row < 15, -(self.row + 1 >> 1))
        kept += self.seen
        stays = self.row > 2
        stays |= self.hit
        self.last[self.slot] = np.where(stays, kept, new)
        self.prev1, self.hash2 = x, self.hash1 << 2
        self.hash1 = x.astype(np.int64)
        self.hash1 *= 40503


def encode_blocks(ranks: np.ndarray, entries: np.ndarray, size: int, prior: _Prior) -> list[bytes]:
    """ranks, with their entries, in blocks of `size`, the last filled up with the first rank, each coded from the prior."""
    lanes = -(-len(ranks) // size)
    fill = np.zeros(lanes * size - len(ranks), np.int32)
    table, tops = (np.ascontiguousarray(np.append(x, fill).reshape(lanes, size).T) for x in (entries, ranks))
    m = _Model(prior, lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out, end, lane = np.zeros(((2 * size + 9) * lanes,), np.uint32), np.arange(lanes), np.arange(lanes)

    def emit(need: np.ndarray) -> None:
        """A word of each lane that needs it; the others write over theirs later."""
        nonlocal end
        out[end] = (low >> _U(48)).astype(np.uint32)
        end += need * lanes
        shift = need.astype(_U) << _U(4)
        np.left_shift(low, shift, out=low)
        np.left_shift(span, shift, out=span)

    for t in range(size):
        entry, x = table[t], tops[t]
        if t >= size - len(fill):
            entry[-1] = prior.rest[m.prev1[-1]]
        at = entry.astype(np.int64)
        m.predict()
        start, many = m.place(entry, at)
        missed = np.flatnonzero(_take(m.is_rest, at))
        r = span >> _U(_SCALE)
        start *= r
        start += low
        span = r * many
        if len(missed):
            few = x[missed]
            begin, r = prior.zero[few], span[missed] >> _U(_REST)
            start[missed] += r * begin.view(_U)
            span[missed] = r * (prior.zero[few + 1] - begin).view(_U)
        carry = start < low
        if carry.any():
            out[end[carry] - lanes] += np.uint32(1)
        low = start
        emit(span < _U(1 << 48))
        few = np.flatnonzero(span < _U(1 << 48))
        while len(few):
            out[end[few]] = low[few] >> _U(48)
            end[few] += lanes
            low[few] <<= _U(16)
            span[few] <<= _U(16)
            few = few[span[few] < _U(1 << 48)]
        m.update(x, entry, missed)
    for _ in range(4):
        emit(np.ones(lanes, bool))
    count = (end - lane) // lanes
    out = out.reshape(-1, lanes)[: int(count.max())]
    for k in range(len(out) - 1, 0, -1):  # carries into words already out
        out[k - 1] += out[k] >> np.uint32(16)
        out[k] &= np.uint32(0xFFFF)
    words = np.ascontiguousarray(out.astype("<u2").T)
    return [words[k, : count[k]].tobytes() for k in range(lanes)]


def decode_blocks(blocks: list[bytes], size: int, prior: _Prior) -> np.ndarray:
    """The ranks of all blocks, end to end."""
    lanes = len(blocks)
    m = _Model(prior, lanes)
    prior.index()
    rank = prior.rank.astype(np.int32)
    length = np.array([len(b) // 2 for b in blocks])
    words = np.frombuffer(b"".join(blocks) + bytes(64), "<u2").astype(_U)
    at = np.cumsum(length) - length
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _U(16)) | _take(words, at)
        at += 1
    span, table = np.full(lanes, 2**64 - 1, _U), np.zeros((size, lanes), np.int32)

    for t in range(size):
        m.predict()
        r = span >> _U(_SCALE)
        v = np.minimum(code // r, _U((1 << _SCALE) - 1))  # over it in damaged blocks alone
        entry = m.at(v.astype(np.int32))
        index = entry.astype(np.int64)
        start, many = m.place(entry, index)
        start *= r
        code -= start
        span = r * many
        x = _take(rank, index)
        missed = np.flatnonzero(_take(m.is_rest, index))
        if len(missed):
            r = span[missed] >> _U(_REST)
            v = np.minimum((code[missed] // r).view(np.int64), (1 << _REST) - 1)
            x[missed] = found = np.searchsorted(prior.zero, v, "right") - 1
            begin = prior.zero[found]
            code[missed] -= r * begin.view(_U)
            span[missed] = r * (prior.zero[found + 1] - begin).view(_U)
        need = span < _U(1 << 48)
        shift = need.astype(_U) << _U(4)
        code <<= shift
        span <<= shift
        code |= _take(words, at) * need
        at += need
        few = np.flatnonzero(span < _U(1 << 48))
        while len(few):
            code[few] = code[few] << _U(16) | _take(words, at[few])
            span[few] <<= _U(16)
            at[few] += 1
            few = few[span[few] < _U(1 << 48)]
        table[t] = x
        m.update(x, entry, missed)
    return table.T.reshape(-1)


def pack(ids: np.ndarray) -> bytes:
    """One segment's payload."""
    if not len(ids):
        return _MAGIC + np.zeros(5, "<u4").tobytes()
    size = int(min(_MOST_BLOCK, max(_LEAST_BLOCK, -(-len(ids) // _LANES))))
    prior, ranks, entries = _Prior.of(ids, size)
    if len(prior.names) >= 1 << 22:
        raise ValueError(f"more than {1 << 22} different ids in a segment")
    blocks = encode_blocks(ranks, entries, size, prior)
    sums = [zlib.crc32(x) for x in np.split(ids.astype("<u4"), range(size, len(ids), size))]
    model = prior.tobytes()
    head = np.array([size, len(blocks), len(prior.names), len(model), zlib.crc32(model)], "<u4").tobytes() + np.array([[len(b) for b in blocks], sums], "<u4").tobytes()
    return _MAGIC + head + model + b"".join(blocks)


def unpack(payload: bytes, n: int) -> np.ndarray:
    """The n ids of a payload, each block held against its checksum."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a segment of coded ids")
    size, many, names, model, check = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
    if not many:
        return np.zeros(0, np.int64)
    lengths, sums = np.frombuffer(payload, "<u4", 2 * many, 24).reshape(2, many)
    first = 24 + 8 * many
    ends = first + model + np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    if ends[-1] != len(payload):
        raise ValueError("the segment is cut off")
    if zlib.crc32(payload[first : first + model]) != check:
        raise ValueError("the header does not match its checksum")
    prior = _Prior.frombytes(payload[first : first + model], names, many)
    ids = prior.names[decode_blocks([payload[a:b] for a, b in zip(ends, ends[1:])], size, prior)[:n]]
    for k, s in enumerate(sums):
        if zlib.crc32(ids[k * size : (k + 1) * size].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {k} does not match its checksum")
    return ids


#: How the tokenizer file cuts text, where words of plain letters are parts of their own whatever follows them.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"  # each its own composed form, with one lower-case letter each
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe, which may begin a part with letters
_EASY = f"^[{_LETTERS}]+[{re.escape(_TAIL)}]*$"
#: How ByteLevel spells bytes: those without a visible character of their own are the characters from 256 on.
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]).astype(kind, copy=False) for k, kind in enumerate((np.uint32, np.int64)))


class _Known:
    """The ids of strings that were met before; with over `most` of them, of those met last alone."""

    def __init__(self, most: int):
        self.most = most
        self.names, self.data, self.many = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids(self, names: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many are each name's, of different names; `learn` gives those of the ones that are new."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = names.take(pa.array(new))
            data, many = learn(unknown)
            at[new] = len(self.many) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, unknown.cast(pa.string())])
            self.data, self.many = np.concatenate([self.data, data]), np.concatenate([self.many, many])
        found = take_ranges(self.data, (np.cumsum(self.many) - self.many)[at], self.many[at])
        many = self.many[at]
        if len(self.many) > self.most:
            self.names, self.data, self.many = names.cast(pa.string()), found, many
        return found, many


class _Tokens:
    """Ids of texts by the tokenizers library; text between spaces is encoded once and kept for a while.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its parts between spaces. Where
    the file cuts letters from punctuation, a word's letters are put into lower case and encoded apart from the marks that
    end it, by the same model without the normalising and cutting that they do not need."""

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.kept, self.cores = _Known(1_000_000), _Known(1_000_000)
        mark = self._ids(["a \0 b"])[0]
        ends = self._ids(["a", "b"])
        inner = mark[len(ends[0]) : len(mark) - len(ends[1])]
        self.mark = int(inner[0]) if len(inner) == 1 else None
        self.plain = self._plain(json.loads(content))

    def _plain(self, file: dict):
        """A tokenizer whose model takes words of lower-case letters, spelled by byte; None where the file cuts in another way."""
        from tokenizers import Tokenizer

        steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = file["model"].get("end_of_word_suffix")
        extra = any(re.fullmatch(_EASY, t["content"]) for t in file.get("added_tokens") or [])
        known = steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _CUT} and cuts[1]["type"] == "ByteLevel"
        if not known or extra or not suffix or file["model"].get("dropout"):
            return None
        return Tokenizer.from_str(json.dumps(file | {"normalizer": None, "post_processor": None, "pre_tokenizer": None}))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _full(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many are each part's, by the whole tokenizer."""
        out = []
        for a in range(0, len(new), 2000):
            part = new[a : a + 2000]
            if self.mark is not None and not any("\0" in p for p in part):
                ids = self._ids([" \0 ".join(part)])[0]
                cuts = np.flatnonzero(ids == self.mark)
                out.append((np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1))
            else:
                ids = self._ids(part)
                out.append((np.concatenate(ids), np.array([len(i) for i in ids])))
        return _joined(out)

    def _letters(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many are each word's, of words of lower-case letters."""
        model, ids, many = self.plain.model, [], []
        for word in new.to_pylist():
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_LEVEL)
            found = model.tokenize(word)
            ids += [t.id for t in found]
            many.append(len(found))
        return np.array(ids, np.uint32), np.array(many, np.int64)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many are each part's, of new parts."""
        if self.plain is None:
            return self._full(new.to_pylist())
        easy = pc.match_substring_regex(new, _EASY)
        words, other = new.filter(easy), new.filter(pc.invert(easy))
        cores = pc.utf8_lower(pc.utf8_rtrim(words, characters=_TAIL)).dictionary_encode()
        tails = pc.replace_substring_regex(words, f"^[{_LETTERS}]+", "").dictionary_encode()
        parts = [self.cores.ids(cores.dictionary, self._letters), self._full(tails.dictionary.to_pylist()), self._full(other.to_pylist())]
        ids, many = _joined(parts)
        begin, second, third = np.cumsum(many) - many, len(parts[0][1]), len(parts[0][1]) + len(parts[1][1])
        pieces = np.full((len(new), 2), len(many))  # each new part is a core and what ends it, or one piece
        mask = easy.to_numpy(zero_copy_only=False)
        pieces[mask] = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + second], 1)
        pieces[~mask, 0] = np.arange(third, len(many))
        begin, many = np.append(begin, 0)[pieces], np.append(many, 0)[pieces]
        return take_ranges(ids, begin.reshape(-1), many.reshape(-1)), many.sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many are each text's."""
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        data, length = self.kept.ids(coded.dictionary, self._learn)
        codes = coded.indices.to_numpy()
        many = length[codes]
        upto = np.concatenate([[0], np.cumsum(many)])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return take_ranges(data, (np.cumsum(length) - length)[codes], many), np.diff(upto[ends])


_tokens: dict[int, _Tokens] = {}


def _tokenizer(content: str) -> _Tokens:
    key = zlib.crc32(content.encode())
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = _Tokens(content)
    return _tokens[key]


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, segment_ids: int = 4 << 20) -> None:
    """Encodes all texts and writes them to `path` in ascending order of id."""
    import public_tokenizers

    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = partitions(docs)
    ordered = source.repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(content.value)
        held: list = []
        size = segment = 0

        def close() -> pa.RecordBatch:
            ids, names, lengths, part = (np.concatenate([h[k] for h in held]) for k in range(4))
            row = [pa.array([part[0]], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names.tolist()], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "segment", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for piece in slices(batch, "text", 16 << 20):
                ids, many = tokens.encode(piece.column("text"))
                if size >= segment_ids and len(ids) >= segment_ids // 4:  # a short rest is no segment of its own
                    yield close()
                    held, size, segment = [], 0, segment + 1
                ids = np.insert(ids.view(np.int32), np.cumsum(many), end_id)
                held.append((ids, np.array(piece.column("id").to_pylist(), object), many + 1, piece.column("part").to_numpy()))
                size += len(ids)
        if held:
            yield close()

    ordered.mapInArrow(run, "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in the files."""
    rows = spark.read.parquet(path)
    # One narrow row a segment: the ids before it.
    before = rows.select("part", "segment", (F.sum("n_ids").over(Window.orderBy("part", "segment")) - F.col("n_ids")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                all_ids = unpack(row["payload"].as_buffer().to_pybytes(), row["n_ids"].as_py()).astype("<u4")
                lengths = row["lengths"].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(lengths)])
                data = memoryview(all_ids.tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                n = len(lengths)
                out = [pa.array(np.full(n, row["part"].as_py(), np.int32)), pa.array(np.full(n, row["segment"].as_py(), np.int32)), row["doc_ids"].values, pa.array(at[:-1]), pa.array(lengths), pa.array(sums, pa.int64())]
                names = ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(all_ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    docs = rows.mapInArrow(run, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return docs.join(before, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op2_range_coder(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "range-coder").path("ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, ids=False)
