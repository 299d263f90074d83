"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A sequence of tokens is what the merge list makes of a text exactly if each two neighbours are what it makes of their own text. So each prefix has one
last token: the one of those that end there which fits the last token of the prefix before it. A byte that comes later can change a token only within the merge list's
lookahead; so much is read ahead, and a token is emitted once every prefix that a later token can start from has it.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.frames import in_arrow
from cambium.llm.memory import REMEMBERED, Memory, kept

#: White_Space of Unicode, as the tokenizer's own pattern takes \s.
_S = "\t-\r \x85\xa0  -     　"
#: Where white space begins after something else. No piece spans that.
_EDGE = re.compile(f"(?<=[^{_S}])(?=[{_S}])")
#: Characters of a text that are encoded at once; more, up to the next such place.
SEGMENT = 1 << 14
#: The split pattern that belongs to this kind of vocabulary file. Words stand before contractions, as nothing can begin both.
_PIECE = regex.compile(rf""" ?\p{{L}}++| ?\p{{N}}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+""")

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if visible, else the next unused one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encoder and decoder of one vocabulary file (tokenizer.json with a BPE model on bytes)."""

    def __init__(self, source: bytes, remembered: int = REMEMBERED):
        spec = json.loads(source)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids: dict[bytes, int] = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[bytes, bytes], int] = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes: list[bytes] = [own.get(i, b"") for i in range(max(own) + 1)]
        self.longest = max(map(len, self.ids))
        self.lookahead = self._lookahead()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = {t: i for t, i in self.ids.items() if self.merged(t) == [t]}
        #: All tokens that end at a byte, the longest first.
        self.machine = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.machine.add_word(t.decode("latin-1"), (i, len(t)))
        self.machine.make_automaton()
        self.shift = len(self.bytes).bit_length()
        self.parts = {a + b: (a, b) for (a, b), _ in sorted(self.rank.items(), key=lambda m: -m[1])}
        self.made = {t: self.rank[x] for t, x in self.parts.items()}
        self.fits: Memory = Memory(lambda pair: self._fits(self.bytes[pair >> self.shift], self.bytes[pair & ((1 << self.shift) - 1)]), remembered)
        self.pieces: Memory = Memory(self._piece, remembered)
        self.shown = [b"%d," % i for i in range(len(self.bytes))]
        self.size = list(map(len, self.bytes))

    def _lookahead(self) -> int:
        """Bytes after a token that settle it.

        A byte more can block a merge (x, y); what it leaves open to its left is a merge (w, x) of lower priority, and so on leftwards. The bound is the
        longest such chain of merges with falling priority, in bytes, and one token more.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for (x, y), _ in sorted(self.rank.items(), key=lambda m: -m[1]):
            own = len(y) + reach.get(x, len(x))
            reach[y] = max(reach.get(y, 0), own)
            most = max(most, own)
        return most + self.longest

    def merged(self, text: bytes) -> list[bytes]:
        """The merge list applied literally: the first of the best-ranked pairs is merged, again and again. Only for tokens and pairs of them."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i) for i in range(len(parts) - 1))
            if best == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, x: bytes, y: bytes) -> bool:
        """Whether x and y stay apart when their joined text is merged.

        Their own merges are undone, latest first; what lies at the border then must not have a merge that would have come before the one undone. Of
        equally ranked merges the one further left comes first.
        """
        before = len(self.rank)
        while True:
            if self.rank.get((x, y), before) < before:
                return False
            of_x, of_y = self.made.get(x, -1), self.made.get(y, -1)
            if of_x > of_y:
                before, x = of_x, self.parts[x][1]
            elif of_y >= 0:
                before, y = of_y + 1, self.parts[y][0]
            else:
                return True

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that comes in blocks. Held at any time: a block, twice the lookahead in bytes, and the last token of each prefix that ends there."""
        fits, shift, longest, ahead = self.fits, self.shift, self.longest, self.lookahead
        last, size, base, found = [0], [0], 0, None
        for block in blocks:
            for at in range(0, len(block), ahead):
                part = block[at : at + ahead].decode("latin-1")
                start, offset, ended = len(last), len(last) - 1 + base, base + len(last) - 1
                last += [-1] * len(part)
                size += [0] * len(part)
                if found is None:
                    found = self.machine.iter(part)
                else:
                    found.set(part)  # goes on where the part before ended
                for end, (t, n) in found:
                    if end < ended:
                        continue
                    begin = end + 1 - n - base
                    if begin >= 0 and last[begin + n] < 0 and (end + 1 == n or last[begin] >= 0 and fits[last[begin] << shift | t]):
                        last[begin + n], size[begin + n] = t, n
                        ended = end + 1
                if -1 in last[start:]:
                    raise ValueError("the vocabulary lacks a byte")
                top = len(last) - 1
                if top < 2 * ahead:
                    continue
                # all that was read more than the lookahead ago is settled: back from all prefixes that a later token can follow they meet
                ends = set(range(max(0, top - longest + 1), top + 1))
                while len(ends) > 1:
                    latest = max(ends)
                    ends.remove(latest)
                    ends.add(latest - size[latest] if latest else 0)
                if (settled := ends.pop()) > 0:
                    out = self._back(last, size, settled)
                    yield from out if base == 0 else out[1:]
                    # what was emitted goes; the last token before the cut stays, to judge neighbours
                    cut = settled - size[settled]
                    last, size, base = last[cut:], size[cut:], base + cut
                    last[0], size[0] = 0, 0
        out = self._back(last, size, len(last) - 1)
        yield from out if base == 0 else out[1:]

    @staticmethod
    def _back(last: list[int], size: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece. In one no longer than the lookahead nothing is settled before its end, so it needs no cuts."""
        text = piece.encode()
        if (t := self.whole.get(text)) is not None:
            return [t]
        if len(text) > self.lookahead:
            return list(self.stream([text]))
        fits, shift, size = self.fits, self.shift, self.size
        last, ended = [-1] * (len(text) + 1), 0
        for end, (t, n) in self.machine.iter(text.decode("latin-1")):
            if end >= ended and (end + 1 == n or fits[last[end + 1 - n] << shift | t]):
                ended = end + 1
                last[ended] = t
        if last.count(-1) > 1:
            raise ValueError("the vocabulary lacks a byte")
        out, end = [], len(text)
        while end:
            out.append(t := last[end])
            end -= size[t]
        out.reverse()
        return out

    def _piece(self, piece: str) -> tuple[tuple[int, ...], bytes, bytes]:
        ids = tuple(self.encode_piece(piece))
        return ids, b"".join(map(self.shown.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def segments(self, text: str) -> Iterator[list[tuple[tuple[int, ...], bytes, bytes]]]:
        """Ids, the same in digits with a comma after each, and the bytes that they stand for, of each piece, some thousand characters at a time. The strings of special tokens
        in a text become those tokens."""
        pieces, most = self.pieces, self.lookahead // 4  # characters that are no more bytes than that
        for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield [((i := self.special[part],), self.shown[i], self.bytes[i])]
                continue
            at = 0
            while at < len(part):
                edge = _EDGE.search(part, at + SEGMENT) if len(part) - at > SEGMENT else None
                end = edge.start() if edge else len(part)
                own = _PIECE.findall(part, at, end) if at or end < len(part) else _PIECE.findall(part)
                at = end
                if own:
                    yield list(map(pieces.__getitem__, own)) if max(map(len, own)) <= most else [pieces[p] if len(p) <= most else self._piece(p) for p in own]

    def encode(self, text: str) -> list[tuple[tuple[int, ...], bytes]]:
        """All segments' pieces: ids and their bytes."""
        return [(ids, raw) for ids, _, raw in chain.from_iterable(self.segments(text))]

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Text, block by block. The state between blocks is the bytes of one unfinished character; what isn't UTF-8 becomes U+FFFD."""
        machine, of, own = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes.__getitem__, iter(ids)
        while part := list(islice(own, block)):
            yield machine.decode(b"".join(map(of, part)))
        yield machine.decode(b"", True)


def transducer(source: bytes, remembered: int = REMEMBERED) -> Transducer:
    """One for each worker process."""
    return kept(("bpe", hashlib.sha256(source).digest(), remembered), lambda: Transducer(source, remembered))


def _tokens(batches: Iterator[pa.RecordBatch], source: bytes, keep: bool, remembered: int = REMEMBERED) -> Iterator[pa.RecordBatch]:
    own = transducer(source, remembered)
    # nothing here refers to itself, and looking for what does takes time with so much remembered
    collecting = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count, digest, decoded, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    # a segment's tokens are all that is held of a text, unless its ids are asked for
                    n, of_ids, of_text, back, ids = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace"), []
                    for segment in own.segments(text or ""):
                        by_piece, shown, raw = zip(*segment, strict=True)
                        of_ids.update(b"," * (n > 0) + b"".join(shown)[:-1])
                        of_text.update(back.decode(b"".join(raw)).encode())
                        n += sum(map(len, by_piece))
                        if keep:
                            ids += chain.from_iterable(by_piece)
                    of_text.update(back.decode(b"", True).encode())
                    count.append(n)
                    digest.append(of_ids.hexdigest())
                    decoded.append(of_text.hexdigest())
                    if keep:
                        kept.append(ids)
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep)
    finally:
        if collecting:
            gc.enable()


def tokenize(docs: DataFrame, path: str, ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ids, the ids themselves, for each row of docs (doc_id, text; other columns are ignored).

    path: a tokenizer.json on the driver (a few MB; its bytes are sent to the executors). Null is empty text: no tokens. Texts are encoded whole, special
    tokens' strings as those tokens, none added. Repeated rows each give a row; a null doc_id stays null. There is no shuffle.
    """
    with open(path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, lambda batches: _tokens(batches, source.value, ids, remembered), schema)
