"""SentencePiece encoding and decoding with a merge-type prefix table.

For every prefix of a string the table holds the one token that the prefix's encoding ends
with. A token that an automaton finds ending there is that token exactly when it is
compatible with the last token of the prefix before it, that is, when the two tokens'
text encodes to these two tokens. The ids are then read backwards.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from varloom.llm.common import table

SPACE = "▁"
#: Texts that tell other normalisers, prefixes and fallbacks apart.
PROBES = ("the cat sat on the mat", "  two  spaces  ", "\ufb01 \u2460 \u00a0x\u3000y", "A\nb \n c\t", "\u6f22\U0001f600", "Stra\u00dfe na\u00efve caf\u0065\u0301")
#: Entries of the caches of a worker: speed only, results don't depend on them.
KEPT_WORDS, KEPT_PAIRS = 450_000, 400_000


def merges(text: str, score: dict[str, float]) -> tuple[list[tuple[float, str, str]], int]:
    """Merges of a text in the order of highest score, then leftmost: (score, first symbol, last symbol) after each; and the symbols left."""
    s, steps = list(text), []
    while True:
        best, at = None, -1
        for i in range(len(s) - 1):
            x = score.get(s[i] + s[i + 1])
            if x is not None and (best is None or x > best):
                best, at = x, i
        if best is None:
            return steps, len(s)
        s[at : at + 2] = [s[at] + s[at + 1]]
        steps.append((best, s[0], s[-1]))


class PrefixTable:
    """Encoder and decoder of one model file; ids equal those of the sentencepiece library.

    It takes merge-type models that leave the text as it is, put a space before it, and have no
    piece that goes on over a space or a line end. Another model is refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = [0] * 256
        self.surface: list[bytes] = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_byte(i):
                b = int(self.pieces[i][3:-1], 16)
                self.byte[b], self.surface[i] = i, bytes([b])
            elif sp.is_control(i):
                self.surface[i] = b""
        self.automaton = ahocorasick.Automaton()
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.chars = {p for p in self.score if len(p) == 1}
        for i in plain:
            self.steps[i], left = merges(self.pieces[i], self.score)
            if left == 1:  # a piece that its own text doesn't encode to never ends a prefix
                self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        over = [p for p in self.score if SPACE in p.lstrip(SPACE) or "\n" in p.lstrip(SPACE)[1:]]
        self.done = _Done(self)
        if over or any(self.encode(t) != sp.encode(t) for t in PROBES):
            raise ValueError(f"not a merge-type model that this encoder can take: {path}")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b encodes to [a, b]: no merge across their boundary comes first."""
        left, right, score = self.steps[a], self.steps[b], self.score
        x, y, i, j = self.pieces[a][-1], self.pieces[b][0], 0, 0
        while True:
            across = score.get(x + y)
            p = left[i][0] if i < len(left) else None
            q = right[j][0] if j < len(right) else None
            if across is not None and (p is None or across > p) and (q is None or across >= q):
                return False
            if p is None and q is None:
                return True
            if q is None or (p is not None and p >= q):
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last: list[int] = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (length, t) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length
            if start:
                key = last[start] << 20 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = self.compatible(last[start], t)
                    if len(pairs) < KEPT_PAIRS:
                        pairs[key] = ok
                if not ok:
                    continue
            last[end + 1] = t
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        return ids[::-1]

    def segment(self, text: str) -> list[int]:
        """Ids of a text of any characters; those that are no piece become bytes and part the rest."""
        chars = self.chars
        if all(c in chars for c in text):
            return self.known(text)
        ids, run = [], 0
        for i, c in enumerate(text):
            if c not in chars:
                ids += self.known(text[run:i])
                ids += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
                run = i + 1
        return ids + self.known(text[run:])

    def split(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: a space run with the word after it, or a line end with the word after it.

        A part is named without its first space, so plain words are their own names.
        """
        parts = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:
            if p == "":
                run += 1
            elif p[0] == "\n":
                if run:
                    out.append(SPACE * (run - 1))
                out.append(p)
                run = 0
            else:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * (run - 1))
        return out

    def encode_parts(self, text: str) -> list[tuple[str, str]]:
        """(decimal ids, comma-joined; their text) of each part of the text; none for an empty text."""
        return list(map(self.done.__getitem__, self.split(text))) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.encode_parts(text) for x in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class _Done(dict):
    """Part -> its ids and what they decode to: one entry for both, as a worker's memory is small."""

    def __init__(self, owner: PrefixTable):
        self.owner = owner

    def __missing__(self, part: str) -> tuple[str, str]:
        ids = self.owner.segment(part if part[:1] == "\n" else SPACE + part)
        text = b"".join(map(self.owner.surface.__getitem__, ids)).decode("utf-8", "replace")
        found = (",".join(map(str, ids)), text)
        if len(self) < KEPT_WORDS:
            self[part] = found
        return found


@functools.lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    """One table per worker process and model file."""
    return PrefixTable(path)


def encoded(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep's columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Every row is encoded whole and decoded again; null is as empty: no ids, empty text. The
    work is by row, so ties, repeats and table size don't matter, and memory is one batch and
    the bounded caches. model is a path that every worker can open. A kept column that has
    the name of a result gives way.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * with_ids]]
    keep = tuple(c for c in keep if c not in results)
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("__t"))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    more = ", ids array<int>, decoded string" if with_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_table(model)
        for batch in batches:
            n, ids, sums, texts = [], [], [], []
            for t in batch.column(len(names)):
                parts = encoder.encode_parts(t.as_py() or "")
                joined, decoded = ",".join([x[0] for x in parts]), "".join([x[1] for x in parts])
                decoded = decoded[1:] if decoded[:1] == " " else decoded
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                sums.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    texts.append(([int(x) for x in joined.split(",")] if joined else [], decoded))
            cols = [*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(sums, pa.string())]
            if with_ids:
                cols += [pa.array([x[0] for x in texts], pa.list_(pa.int32())), pa.array([x[1] for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*names, *results])

    out = rows.mapInArrow(work, f"{own}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnsRenamed(dict(zip(names, keep)))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), model_path())
