"""Queries of the training-data operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format
from .chat_format import chat_digests, with_probe, write_chats
from .common import table
from .decontaminate import MASKS, MIN_SCORE, MIN_WORDS, contaminated
from .exact_dedup import exact_dedup
from .license_texts import NOTICES, SPELLINGS, TEXTS, editions
from .licenses import BLANKS, COPYRIGHT_LINE, PARAGRAPH, STATEMENT, license_scan
from .quality_crf import quality
from .sentencepiece_scan import encode
from .simhash import near_dedup
from .spelling import spelling_variants
from .substring_dedup import substring_digests
from .token_counts import section_tokens
from .token_records import token_records
from .warc import warc_round
from .whitening import whiten

#: The id that closes each document's ids.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), END_ID)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), spaced_from=MIN_WORDS)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash, and digest and length of the text that the ids decode to."""
    model = tokenizer_path("piece_bpe_32k.model")
    back = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, back=True)
    return back.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"), F.length("text").alias("decoded_chars"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(write_chats(with_probe(spark, table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_section_tokens": op1_section_tokens,
    "op2_token_records": op2_token_records,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_crf": op7_quality_crf,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_format": op13_chat_format,
}

BLANK = r"[\x20\x09-\x0D]"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    def canonical(x):
        x = f"regexp_replace({x}, '{BLANKS}', ' ', 'g')"
        for spelling, kept in SPELLINGS:
            x = f"replace({x}, '{spelling}', '{kept}')"
        return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    low, states = "lower(coalesce(text, ''))", f"regexp_matches(x, '{COPYRIGHT_LINE}')"
    lines = f"list_filter(string_split({low}, chr(10)), lambda x: NOT {states})"
    joined = f"list_transform(regexp_split_to_array({low}, '{PARAGRAPH}'), lambda x: regexp_replace(x, '{BLANKS}', ' ', 'g'))"
    paragraphs = f"list_filter({joined}, lambda x: NOT ({states} AND len(string_split(trim(x), ' ')) <= {STATEMENT}))"
    forms = [f"sha256({canonical(x)})" for x in (f"array_to_string({lines}, ' ')", f"array_to_string({paragraphs}, ' ')", low)]
    texts = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, own in TEXTS.items() for t in editions(own))
    notices = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, own in NOTICES.items() for t in own)
    return f"""
        WITH d AS (SELECT doc_id, list_transform({lines}, lambda x: {canonical("x")}) AS lines, {", ".join(f"{x} AS form{k}" for k, x in enumerate(forms))} FROM documents),
        known AS (SELECT min(license_id) AS license_id, digest FROM (SELECT license_id, unnest([{", ".join(forms)}]) AS digest FROM (VALUES {texts}) AS t(license_id, text)) WHERE digest <> sha256('') GROUP BY digest),
        notice AS (SELECT DISTINCT name, {canonical("lower(text)")} AS line FROM (VALUES {notices}) AS t(name, text)),
        found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS notice_lines
                  FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN notice USING (line) GROUP BY doc_id)
        SELECT doc_id, form0 AS text_digest, coalesce(a.license_id, b.license_id, c.license_id) AS license_id, coalesce(notices, '') AS notices, coalesce(notice_lines, 0) AS notice_lines
        FROM d LEFT JOIN known a ON a.digest = form0 LEFT JOIN known b ON b.digest = form1 LEFT JOIN known c ON c.digest = form2 LEFT JOIN found USING (doc_id)
    """


def _decontamination_sql() -> str:
    def words(text):
        return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"

    def seeds(table, key):
        return " UNION ALL ".join(
            f"SELECT {key}, i, '{k}:' || " + " || ' ' || ".join(f"w[i + {o + 1}]" for o, c in enumerate(m) if c == "1") + f" AS seed FROM (SELECT {key}, w, unnest(range(len(w) - {len(m) - 1})) AS i FROM {table} WHERE len(w) >= {len(m)})"
            for k, m in enumerate(MASKS)
        ) + f" UNION ALL SELECT {key}, i, 's' || n || ':' || array_to_string(w[i + 1 : i + n], ' ') FROM (SELECT {key}, w, n, unnest(range(len(w) - n + 1)) AS i FROM {table}, short WHERE len(w) >= n" + (" AND len(w) = n" if key == "item_id" else "") + ")"

    return f"""
        WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents), b AS (SELECT item_id, {words("text")} AS w FROM benchmark WHERE len({words("text")}) >= {MIN_WORDS}),
        short AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) < {max(map(len, MASKS))}),
        hits AS (SELECT DISTINCT doc_id, item_id, x.i - y.i AS diagonal FROM ({seeds("d", "doc_id")}) x JOIN ({seeds("b", "item_id")}) y USING (seed)),
        cells AS (SELECT doc_id, item_id, diagonal, j, len(b.w) AS n, d.w[diagonal + j + 1] = b.w[j + 1] AS same
                  FROM (SELECT hits.*, unnest(range(greatest(0, -diagonal), least(len(b.w), len(d.w) - diagonal))) AS j FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)) JOIN d USING (doc_id) JOIN b USING (item_id)),
        sums AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS s FROM cells),
        best AS (SELECT *, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM sums),
        per AS (SELECT doc_id, item_id, diagonal, max(run) AS score, count(*) FILTER (same) AS equal_words, min(j + diagonal) AS opens, max(n) AS n FROM best GROUP BY ALL)
        SELECT doc_id, item_id, max(score)::INT AS score, max(equal_words)::INT AS equal_words, min(opens)::INT AS first_word, max(n)::INT AS item_words
        FROM per WHERE score >= least({MIN_SCORE}, n) GROUP BY doc_id, item_id
    """


def _chat_sql() -> str:
    def escaped(text, escapes):
        for plain, code in escapes:
            text = f"replace({text}, '{plain}', '{code}')"
        return text

    probe = ", ".join(f"({i}, {turn}, '{role}', '{text}')" for i, turn, role, text in chat_format.PROBE)
    head, end, colon = len(chat_format.HEADER), len(chat_format.TURN_END), len(chat_format.COLON)
    order = "ORDER BY turn NULLS FIRST, escaped_role, escaped_text"
    return f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {probe}) AS t(conv_id, turn, role, text)),
        e AS (SELECT *, {escaped("role", chat_format.ESCAPES)} AS escaped_role, {escaped("text", chat_format.ESCAPES[:-1])} AS escaped_text FROM c),
        r AS (SELECT *, lag(escaped_role) OVER (PARTITION BY conv_id, coalesce(floor(turn / {chat_format.PART_TURNS}), 0) {order}) AS before FROM e)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(escaped_text) + {end} + CASE WHEN before IS NULL OR before <> escaped_role THEN {head + colon + 1} + length(escaped_role) ELSE 0 END)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id
    """


ORACLE_SQL = {
    "op13_chat_format": _chat_sql(),
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
        gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
        cover AS (SELECT DISTINCT doc_id, i + k AS j FROM gone, range(50) AS r(k)),
        cut AS (SELECT doc_id, list(j) AS js FROM cover GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE [w[j + 1] FOR j IN range(len(w)) IF NOT list_contains(js, j)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op3_benchmark_decontamination": _decontamination_sql(),
    "op5_license_scan": _license_sql(),
    "op8_warc_revisits": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS origin FROM p)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT), 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> origin THEN origin END AS refers_to
        FROM o
    """,
    "op9_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS k,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
    """,
}
