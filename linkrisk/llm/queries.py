"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fp_tree, language_id, licences, mixing, packing, prefix_trie, quality, simhash, sstable, suffix_dedup, warc
from .common import scratch, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=0, capacity=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_classes(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("failed_rule")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = sstable.write_shards(docs, scratch(spark, "sst"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


#: A conversation whose texts look like control strings, in another layout than the table's rows.
HARD = '{"messages": [{"role": "user", "content": "\\\\### Assistant: </turn> ok"}, {"role": "assistant", "content": "\\\\### Assistant: </turn> ok"}]}'


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.lit(HARD).alias("record"))
    turns = chat.canonical_turns(rows).unionByName(chat.canonical_turns(hard))
    return chat.digests(chat.parse_formatted(chat.format_turns(turns)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_out(table(spark, sf_dir, "documents"), span=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_by_topics(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("probability", 9).alias("probability"), "sampled",
        "mix_main_topic", F.round("main_probability", 9).alias("main_probability"), "main_sampled",
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"), width=4, distance=4)
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_shards": op4_token_shards,
    "op5_chat_format": op5_chat_format,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_language_id": op11_language_id,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}


def _licence_sql() -> str:
    values = ", ".join(
        "('{}', [{}])".format(k, ", ".join("'" + x + "'" for x in pairs)) for k, pairs in licences.template_bigrams(licences.TEMPLATES)
    )
    return rf"""
        WITH known(licence, pairs) AS (VALUES {values}),
        units AS (
          SELECT doc_id, unnest(CASE WHEN len(string_split(text, chr(10))) > 1
                                     THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS unit,
                 generate_subscripts(CASE WHEN len(string_split(text, chr(10))) > 1
                                     THEN list_append(string_split(text, chr(10)), text) ELSE [text] END, 1) AS line
          FROM documents WHERE text IS NOT NULL),
        words AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
        sets AS (
          SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
          FROM words WHERE len(w) > 1),
        scored AS (
          SELECT doc_id, line, licence, 2.0::DOUBLE * len(list_intersect(pairs, b)) / (len(pairs) + len(b)) AS dice
          FROM sets, known WHERE len(b) + 1e-6 >= len(pairs) * 0.8 / 1.2 AND len(b) <= len(pairs) * 1.2 / 0.8 + 1e-6),
        best AS (
          SELECT * FROM scored WHERE dice >= 0.8
          QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, licence) = 1)
        SELECT doc_id, count(*) AS n_matches, arg_min(licence, (-dice, licence)) AS licence, round(max(dice), 6) AS dice
        FROM best GROUP BY doc_id
    """


ORACLES = {
    "op2_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op3_quality_rules": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
          SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
        windows AS (
          SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        counted AS (SELECT *, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w1, w2) > 1 AS hit FROM windows),
        covered AS (
          SELECT *, hit OR coalesce(lag(hit, 1) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS rep
          FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        by_word AS (
          SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count_if(rep) AS n_repeat,
                 count_if(regexp_matches(word, '\p{L}')) AS lettered
          FROM covered GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
        by_line AS (
          SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups
          FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        by_text AS (
          SELECT doc_id, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\p{Lu}')) AS upper,
                 len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '!')) AS bangs
          FROM docs),
        stats AS (
          SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(dups, 0) AS n_dup_lines,
                 coalesce(n_repeat, 0) AS n_repeat_words, upper, letters, bangs, coalesce(lettered, 0) AS lettered, coalesce(n_lines, 0) AS n_lines
          FROM by_text t LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
        SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT (base_failed OR 5 * n_symbols > n_words OR 10 * upper > 4 * letters OR 10 * bangs > 3 * n_words
                    OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 3 * n_words OR word_chars > 20 * n_words OR 2 * lettered < n_words) AS kept
        FROM judged
    """,
    "op5_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
          SELECT *, length(role) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g'))
                    + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 15 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, p, unhex(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
        least AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT doc_id, p FROM w JOIN least USING (s) WHERE doc_id > first_id),
        marks AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hits),
        numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marks),
        runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, g),
        ends AS (SELECT doc_id, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id),
        gaps AS (
          SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
          UNION ALL SELECT d.doc_id, coalesce(last, 0), n FROM d LEFT JOIN ends USING (doc_id)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN ends USING (doc_id)
    """,
    "op9_license_scan": _licence_sql(),
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p),
        parts AS (
          SELECT *, unnest(range(0, 32)) AS k FROM d),
        chars AS (
          SELECT *, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, 1 + 10 * (k // 8), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INT)) & 31) AS INT), 1) AS c FROM parts)
        SELECT page_id, payload_bytes, string_agg(c, '' ORDER BY k) AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
        FROM chars GROUP BY page_id, payload_bytes, best
    """,
    "op12_ranked_search": r"""
        WITH found AS (
          SELECT doc_id, row_number() OVER () AS r,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents WHERE text IS NOT NULL),
        tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
        docs AS (SELECT r, doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
        scale AS (SELECT count(*) AS cnt, CAST(sum(n) AS BIGINT) AS len FROM docs),
        lengths AS (SELECT r, 10 + (90 * n * cnt) // len AS m FROM docs, scale),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * cnt + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, scale GROUP BY term, cnt),
        wanted AS (
          SELECT DISTINCT item_id,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark WHERE text IS NOT NULL),
        scored AS (
          SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (r) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) QUALIFY rank <= 10
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS j
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
          SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
                 xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                   lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h
          FROM own GROUP BY conv_id),
        sized AS (SELECT a.conv_id, a.n, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS opening FROM convs a LEFT JOIN convs b ON a.base = b.conv_id),
        rebuilt AS (
          SELECT conv_id, j - h + opening AS p, role, text FROM own JOIN sized USING (conv_id) WHERE j >= h
          UNION ALL SELECT s.conv_id, o.j, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.base WHERE o.j < s.h),
        steps AS (
          SELECT conv_id, p + 1 AS depth, string_agg(sha256(role || chr(10) || sha256(text)), '') OVER (PARTITION BY conv_id ORDER BY p) AS path, strlen(text) AS bytes
          FROM rebuilt
          UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
        ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS here FROM steps),
        nodes AS (
          SELECT depth, path, left(path, greatest(strlen(path) - 64, 0)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
                 sha256(coalesce(string_agg(CASE WHEN here THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM ended GROUP BY depth, path),
        kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, path)),
        pairs AS (  -- every node with every node of its subtree, once
          SELECT DISTINCT a.depth, a.path, b.depth AS below, b.path AS at FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        totals AS (
          SELECT p.depth, p.path, count_if(n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
          FROM pairs p JOIN full_nodes n ON n.depth = p.below AND n.path = p.at GROUP BY ALL)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN totals t USING (depth, path) LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.up
    """,
}
