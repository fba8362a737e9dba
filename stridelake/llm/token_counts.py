"""Token counts by section: offset-mapped attribution.

A document is encoded once, as a whole; its tokens' character spans are interval-joined with the spans of its sections
(both in order, by binary search), and a token that crosses a boundary is allocated by `rule`:

* "majority": to the section that holds most of its characters, of equal ones the first;
* "first": to the section of its first character;
* "split": to every section, in proportion to its characters.

Tokens outside all sections are counted in a row with section null, so counts of a document always add up to its tokens.
Sections are its lines (with their line feed), or those of the column that `spans` names (array of struct<name, start,
end>, in order and disjoint); `fields_as_sections` makes one of several text columns. Of equal shares the first section
wins. Null text is empty and has one empty section; null spans are none; null ids and repeated rows are attributed each on
its own; very long texts are encoded whole, PORTION characters of texts at a time or one text; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .unit_encoder import unit_encoder

#: Characters of texts whose tokens are held at once.
PORTION = 1 << 19
SECTION = "doc_id long, section int, name string, start_char int, end_char int, n_tokens double, n_crossing long, doc_tokens long"
RULES = ("majority", "first", "split")


def line_spans(text: str):
    """Starts and ends of the lines of a text, each with its line feed; at least one."""
    import numpy as np

    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.r_[0, ends[:-1]], ends


def portions(texts):
    """(first, number) of stretches of an Arrow column of texts, of up to 200 texts and about PORTION bytes."""
    import pyarrow.compute as pc

    at = n = size = 0
    for i, x in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n == 200 or n and size + x > PORTION:
            yield at, n
            at, n, size = i, 0, 0
        n, size = n + 1, size + x
    if n:
        yield at, n


def attribute(tokens, starts, ends, rule: str):
    """Tokens (n, 2) against sections: count of each section and of the outside, and crossing tokens of each section."""
    import numpy as np

    counts, crossing = np.zeros(len(starts) + 1), np.zeros(len(starts) + 1, np.int64)
    if not len(tokens):
        return counts, crossing
    s, e = tokens[:, 0].astype(np.int64), np.maximum(tokens[:, 1], tokens[:, 0] + 1).astype(np.int64)
    i, j = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e - 1, "right") - 1
    inside = (i == j) & (i >= 0)
    inside[inside] = (s[inside] < ends[i[inside]]) & (e[inside] <= ends[i[inside]])
    np.add.at(counts, i[inside], 1)
    for t in np.flatnonzero(~inside):
        near = range(max(0, i[t]), j[t] + 1)
        held = {k: max(0, min(e[t], ends[k]) - max(s[t], starts[k])) for k in near}
        out = e[t] - s[t] - sum(held.values())
        held = {k: v for k, v in held.items() if v}
        if out:
            held[len(starts)] = out
        if rule == "split":
            shares = {k: v / (e[t] - s[t]) for k, v in held.items()}
        elif rule == "first":
            own = [k for k in held if k < len(starts) and starts[k] <= s[t] < ends[k]]
            shares = {own[0] if own else len(starts): 1.0}
        else:
            shares = {max(held, key=lambda k: held[k]): 1.0}
        for k, v in shares.items():
            counts[k] += v
            crossing[k] += len(held) > 1
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", spans: str | None = None) -> DataFrame:
    """SECTION rows of docs (doc_id, text and, if named, a column of spans)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = spans is not None

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = unit_encoder(tokenizer, spans=True)
        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SECTION.split(", ")]
        for batch in batches:
            for at, n_rows in portions(batch.column("text")):
                part = batch.slice(at, n_rows)
                ids, texts = part.column("doc_id").to_pylist(), [x or "" for x in part.column("text").to_pylist()]
                spans = part.column("spans").to_pylist() if given else [None] * len(ids)
                out = [[] for _ in names]
                for doc_id, text, own, tokens in zip(ids, texts, spans, encoder.spans(texts)):
                    if given:
                        label = [x["name"] for x in own or []]
                        starts, ends = (np.array([x[k] for x in own or []], np.int64) for k in ("start", "end"))
                    else:
                        starts, ends = line_spans(text)
                        label = [None] * len(starts)
                    counts, crossing = attribute(tokens, starts, ends, rule)
                    n = len(starts) + bool(counts[-1] or crossing[-1])
                    section = [*range(len(starts)), None][:n]
                    for column, values in zip(out, ([doc_id] * n, section, [*label, None][:n], [*starts.tolist(), None][:n], [*ends.tolist(), None][:n], counts[:n].tolist(), crossing[:n].tolist(), [len(tokens)] * n)):
                        column.extend(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if given:
        columns.append(F.col(spans).cast("array<struct<name:string,start:int,end:int>>").alias("spans"))
    return bounded(docs).select(*columns).mapInArrow(run, SECTION)


def fields_as_sections(rows: DataFrame, id_column: str, fields: list[str], joiner: str = "\n") -> DataFrame:
    """doc_id, text, spans: the fields joined in order (null: empty), each a section; the joiners lie outside."""
    text = F.concat_ws(joiner, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    spans, at = [], F.lit(0)
    for f in fields:
        size = F.coalesce(F.length(F.col(f).cast("string")), F.lit(0))
        spans.append(F.struct(F.lit(f).alias("name"), at.cast("int").alias("start"), (at + size).cast("int").alias("end")))
        at = at + size + len(joiner)
    return rows.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.array(*spans).alias("spans"))
