"""SentencePiece (BPE) encoding and decoding, giant documents by a max-plus parallel scan.

Pieces never reach over the start of a run of spaces, so a text's ids are those of its units (spaces, then others) in a
row; ordinary documents are encoded so, each distinct unit once per worker. A text longer than `chunk` characters is cut
into chunks at fixed places, wherever these fall. What one chunk has to know of the chunk before is the last piece that
ends at or after the cut: the boundary state. Two adjacent pieces are in an encoding exactly if the two alone encode to
themselves, and a sequence of pieces is the encoding exactly if all its adjacent pairs are such. So with weight -1 for a
piece and -infinity for a pair that is not, the encoding is the one path that a max-plus product keeps:

1. each chunk yields its transfer matrix from boundary states at its start to those at its end;
2. the matrices of a document are combined pairwise, in log rounds (max-plus product is associative), from both ends, which
   fixes the state at every cut;
3. each chunk is backtraced on its own between the states at its two ends.

Inside a chunk only the parts of units at its ends need the dynamic program, unless one unit fills it.

Decoding gives the text back; only U+2581, which the model takes for a space, comes back as a space. Null text is empty
and has no ids; null or repeated ids and rows are encoded row by row; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, shuffle_partitions

#: Characters of a chunk, and more than the longest piece.
CHUNK, PAD = 16384, 32
REMEMBERED = 120_000
UNIT = re.compile(r" *[^ ]+| +")
ENCODED = "doc_id long, ids array<int>"
BOTH = ENCODED + ", text string"


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The worker process's own model, so that what it remembers outlives a task."""
    return PieceModel(path)


class _Known(dict):
    """Ids (as bytes) of a unit without its first space; a lone space is a unit too."""

    def __init__(self, library, space: int):
        self.library = library
        self[""] = array("i", [space]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        value = self[unit] = array("i", self.library.encode(unit)).tobytes()
        return value


class PieceModel:
    """A BPE piece model; inside, a space stands for U+2581."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i).replace("▁", " "): i for i in usual}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelt = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        for i in (i for i in range(len(self.spelt)) if sp.is_control(i)):
            self.spelt[i] = b""
        for b, i in enumerate(self.byte_id):
            self.spelt[i] = bytes([b])
        self.longest = max(map(len, self.id_of))
        if self.longest >= PAD or any(" " in p.lstrip(" ") for p in self.id_of):
            raise ValueError("the model has pieces that reach over the start of a word")
        self.known = _Known(sp, self.id_of[" "])
        self.fits = lru_cache(50_000)(self._fits)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as native 32-bit integers."""
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.known = _Known(self.library, self.id_of[" "])
        text = text.replace("▁", " ")
        units = text.split(" ")
        if "" in units:  # spaces in a row or at an end
            units = [u[1:] for u in UNIT.findall(" " + text)]
        return b"".join(map(self.known.__getitem__, units))

    def text(self, ids: list[int]) -> str:
        """The text of some ids, with the space that encoding puts in front."""
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored adjacent pair, of equal ones the first, is merged until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def token_ids(self, token: str) -> list[int]:
        return [self.id_of[token]] if token in self.id_of else [self.byte_id[b] for b in token.encode()]

    def is_token(self, text: str) -> bool:
        return len(text) == 1 or text in self.id_of

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Boundary states at a cut, as characters before and after it: pieces over or up to it; (0, 0) where a unit begins."""
        if unit_begins(text, cut):
            return [(0, 0)]
        found = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), s + self.longest) + 1):
                if self.is_token(text[s:e]):
                    found.append((cut - s, e - cut))
        return found

    def sweep(self, text: str, begun: dict, end: int):
        """Best weights of the pieces that end at or after `end`, and every piece's best predecessor.

        begun: (start, end) of a last piece so far -> weight, one or a vector of weights by the state at the chunk's start.
        """
        import numpy as np

        at = defaultdict(dict)
        for (s, e), w in begun.items():
            at[e][s] = w
        back: dict = {}
        out = {(s, e): w for (s, e), w in begun.items() if e >= end}
        for pos in range(min(at, default=end), end):
            if not (last := at.pop(pos, None)):
                continue
            free = unit_begins(text, pos)
            for e in range(pos + 1, min(len(text), pos + self.longest) + 1):
                token = text[pos:e]
                if not self.is_token(token):
                    continue
                best = None
                for s, w in last.items():
                    if free or self.fits(text[s:pos], token):
                        best = w - 1 if best is None else np.maximum(best, w - 1)
                        if np.ndim(w) == 0 and (best == w - 1):
                            back[pos, e] = (s, pos)
                if best is not None:
                    at[e][pos] = best
                    if e >= end:
                        out[pos, e] = best
        return out, back

    def inner(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """First and last place in start..end where a unit begins."""
        found = [p for p in range(start, end + 1) if p < len(text) and unit_begins(text, p)] if end - start < 4 * PAD else None
        if found is None:
            first = next((p for p in range(start, end + 1) if p < len(text) and unit_begins(text, p)), None)
            last = next((p for p in range(end, start - 1, -1) if p < len(text) and unit_begins(text, p)), None)
            return None if first is None else (first, last)
        return (found[0], found[-1]) if found else None

    def transfer(self, text: str, start: int, end: int, final: bool):
        """States at start and end of a chunk (a stretch of text), and the max-plus matrix between them."""
        import numpy as np

        ins = self.states(text, start)
        outs = [(0, 0)] if final else self.states(text, end)
        entry = np.where(np.eye(len(ins), dtype=bool), 0.0, -np.inf)
        begun = {(start - a, start + b): entry[i] for i, (a, b) in enumerate(ins)}
        cuts = self.inner(text, start, end)
        row = {}
        if cuts:
            first, last = cuts
            head, _ = self.sweep(text, begun, first)
            vector = np.max([w for (_, e), w in head.items() if e == first] or [np.full(len(ins), -np.inf)], axis=0)
            # all paths share the units from first to last, so these need not be counted
            begun = {(last, last): vector}
        if final or end > (cuts[1] if cuts else -1):
            row, _ = self.sweep(text, begun, end)
        else:
            row = {(end, end): begun[end, end]}
        matrix = np.full((len(ins), len(outs)), -np.inf)
        for (s, e), w in row.items():
            if final and e == end:
                matrix[:, 0] = np.maximum(matrix[:, 0], w)
            elif not final:
                j = outs.index((0, 0) if outs == [(0, 0)] and e == end else (end - s, e - end))
                matrix[:, j] = np.maximum(matrix[:, j], w)
        return ins, outs, matrix

    def backtrace(self, text: str, start: int, end: int, final: bool, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the pieces after the entry state's piece, up to and with the leaving state's."""

        def path(begun, stop, goal):
            reached, back = self.sweep(text, {begun: 0.0}, stop)
            if goal is None:  # whichever ends there
                goal = max((x for x in reached if x[1] == stop), key=lambda x: reached[x])
            tokens = []
            while goal != begun:
                tokens.append(text[goal[0] : goal[1]])
                goal = back[goal]
            return [i for t in reversed(tokens) for i in self.token_ids(t)]

        begun = (start - entry[0], start + entry[1])
        goal = None if final or leave == (0, 0) else (end - leave[0], end + leave[1])
        cuts = self.inner(text, start, end)
        if not cuts:
            return path(begun, end, goal)
        first, last = cuts
        ids = path(begun, first, None) if begun != (first, first) else []
        ids += array("i", self.ids(text[first + 1 : last])) if last > first else []
        return ids + (path((last, last), end, goal) if end > last else [])


def unit_begins(text: str, at: int) -> bool:
    return at < len(text) and text[at] == " " and (at == 0 or text[at - 1] != " ")


def product(a, b):
    """Max-plus product of two matrices."""
    import numpy as np

    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def _plain(model: str, back: bool):
    """Rows of ids; with `back`, of the text that these decode to as well, so that one worker does both."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pieces = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [pieces.ids(t or "") for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                columns, names = [part.column("doc_id"), ids], ["doc_id", "ids"]
                if back:
                    columns.append(pa.array([pieces.text(array("i", x)).removeprefix(" ") for x in raw], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


CHUNKS = "uid, doc_id, k, start, size, final, piece"


def chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """CHUNKS rows: each chunk with PAD characters of the text on either side (`start` of them before it)."""
    text = F.concat(F.lit(" "), F.translate("text", "▁", " "))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text.alias("text")).withColumn("n", F.length("text"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)).alias("k"))
    a = F.col("k") * chunk
    size = F.least(F.lit(chunk), F.col("n") - a)
    start = F.least(a, F.lit(PAD))
    piece = F.substring("text", a - start + 1, start + size + PAD)
    return rows.select("uid", "doc_id", "k", start.alias("start"), size.alias("size"), (a + size == F.col("n")).alias("final"), piece.alias("piece"))


def _transfers(model: str):
    def run(batches):
        import pyarrow as pa

        pieces = piece_model(model)
        for batch in batches:
            rows = []
            for r in (x for at in range(0, batch.num_rows, 50) for x in batch.slice(at, 50).to_pylist()):
                ins, outs, matrix = pieces.transfer(r["piece"], r["start"], r["start"] + r["size"], r["final"])
                rows.append({"uid": r["uid"], "k": r["k"], "ins": [list(x) for x in ins], "outs": [list(x) for x in outs], "matrix": matrix.ravel().tolist()})
            schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("ins", pa.list_(pa.list_(pa.int32()))), ("outs", pa.list_(pa.list_(pa.int32()))), ("matrix", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def products(matrices: list) -> list:
    """Max-plus products of all prefixes: neighbours are combined pairwise, in as many rounds as the logarithm of their number."""
    if len(matrices) < 2:
        return matrices
    pairs = products([product(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else product(pairs[i // 2 - 1], matrices[i]))
    return out


def _states(rows: list[dict]) -> list[dict]:
    """The state at every cut of one document, from its chunks' matrices in order."""
    import numpy as np

    matrices = [np.array(r["matrix"]).reshape(len(r["ins"]), len(r["outs"])) for r in rows]
    ahead = [np.zeros((1, 1)), *products(matrices)]
    behind = [np.zeros((1, 1)), *(m.T for m in products([m.T for m in reversed(matrices)]))]
    best = [int(np.argmax(a.ravel() + b.ravel())) for a, b in zip(ahead, behind[::-1])]
    return [{"uid": r["uid"], "k": r["k"], "enter": r["ins"][i], "leave": r["outs"][j]} for r, i, j in zip(rows, best, best[1:])]


def _scan(batches):
    """Transfer rows in order of document and chunk -> the states at each chunk's ends."""
    import pyarrow as pa

    schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("enter", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32()))])
    held: list[dict] = []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and held[-1]["uid"] != r["uid"]:
                out += _states(held)
                held = []
            held.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    yield pa.RecordBatch.from_pylist(_states(held) if held else [], schema=schema)


def _backtraces(model: str):
    def run(batches):
        import pyarrow as pa

        pieces = piece_model(model)
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                rows = []
                for r in batch.slice(at, 50).to_pylist():
                    ids = pieces.backtrace(r["piece"], r["start"], r["start"] + r["size"], r["final"], tuple(r["enter"]), tuple(r["leave"]))
                    rows.append({"uid": r["uid"], "doc_id": r["doc_id"], "k": r["k"], "ids": ids})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def encode_giant(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """ENCODED rows of docs by the parallel scan: chunks are dealt out over all tasks."""
    parts = shuffle_partitions(docs.sparkSession)
    # written once, so that the rows' numbers stay as they are
    cut = saved(chunks(docs, chunk).repartition(parts, "uid", "k"), "chunks")
    states = cut.mapInArrow(_transfers(model), "uid long, k int, ins array<array<int>>, outs array<array<int>>, matrix array<double>")
    # a few numbers a chunk: a document's are taken together, in order
    states = states.repartition(parts, "uid").sortWithinPartitions("uid", "k").mapInArrow(_scan, "uid long, k int, enter array<int>, leave array<int>")
    traced = cut.join(states, ["uid", "k"]).mapInArrow(_backtraces(model), "uid long, doc_id long, k int, ids array<int>")
    whole = traced.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("of"))
    return whole.select("doc_id", F.flatten(F.transform("of", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, back: bool = False) -> DataFrame:
    """ENCODED rows: the ids that the model's own library gives for every whole text; with `back`, BOTH: decoded again."""
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk
    plain = rows.where(~giant).mapInArrow(_plain(model, back), BOTH if back else ENCODED)
    others = encode_giant(rows.where(giant), model, chunk)
    return plain.union(decode(others, model) if back else others)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of ENCODED rows."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = pc.fill_null(part.column("ids"), [])
                values, cuts = lists.flatten().to_numpy(zero_copy_only=False), [0, *pc.list_value_length(lists).to_numpy().cumsum().tolist()]
                texts = [pieces.text(values[a:b].tolist()).removeprefix(" ") for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, BOTH)
