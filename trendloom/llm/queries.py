"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import alignment, bpe, chat, ctw, decontam, divergence, html_text, licenses, neardup, pii, quality, rules, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    out = chat.format_chats(chat.streamed_events(rows.unionByName(extra)))
    out = out.select("conv_id", "formatted", "loss_turns", chat.read_back(F.col("formatted")).alias("turns"))
    out = out.select(
        "*", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform(F.filter(F.arrays_zip("turns", "loss_turns"), lambda t: t["loss_turns"]), lambda t: t["turns"]["text"]), "").alias("loss"),
    )
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = rules.apply_rules(docs, measures=base)
    failed = rules.BASE[0].rejects() | rules.BASE[1].rejects()
    return out.select("doc_id", *base, failed.alias("base_failed"), "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    out = quality.score_documents(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"), matches=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    tables = spark.sparkContext.broadcast((bpe.token_bytes(ranks), [str(i) for i in range(max(ranks.values()) + 1)]))

    @F.arrow_udf("struct<ids:string,decoded:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Of the decimal ids and of the decoded bytes."""
        data, names = tables.value
        for column in batches:
            out = [{"ids": hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), "decoded": hashlib.sha256(bpe.decode_ids(ids, data)).hexdigest()} for ids in bpe.lists(column)]
            yield pa.array(out, pa.struct([("ids", pa.string()), ("decoded", pa.string())]))

    out = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digests("ids").alias("d"))
    return out.select("doc_id", "n_tokens", F.col("d.ids").alias("ids_sha256"), F.col("d.decoded").alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_pii(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.find_licenses(table(spark, sf_dir, "documents"))
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return out.select("doc_id", "license_id", "matched_words", "template_words", "coverage", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", span), ",").alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.align_documents(table(spark, sf_dir, "documents"), a, b)
    return out.withColumn("groups_sha256", F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"), ~ctw.held_out(F.col("doc_id")))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_sharding": op6_sharding,
    "op7_pii": op7_pii,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL = {
    "op1_chat_formatting": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g') AS body,
                regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g') AS name FROM said)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(7 + length(body) + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(name) END)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op4_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines
            FROM documents),
        k AS (SELECT row_number() OVER () AS rid, * FROM w),
        g AS (SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS gram
            FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM k)),
        r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
        c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
        m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
                len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t\n\x0b\f\r]*[-*•]'))) AS n_bullet_lines,
                len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\n\x0b\f\r]*$'))) AS n_cut_lines
            FROM k LEFT JOIN c USING (rid)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR 100 * n_digits > 50 * word_chars
                OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_cut_lines > 30 * n_lines) AS kept
        FROM b""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        k AS (SELECT row_number() OVER () AS rid, * FROM d),
        o AS (SELECT rid, lang, source, unnest(terms) AS term FROM k),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
        lt AS (SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*)::HUGEINT AS kinds FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        gt AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * lt.kinds) AS p,
                1 + (1000000000::HUGEINT * (kept.lang_n + 2)) // (lt.lang_total + 2 * lt.kinds) AS q
            FROM gt JOIN kept USING (lang) JOIN lt USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = kept.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        allpairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
        u AS (SELECT * FROM allpairs UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 10""",
}
