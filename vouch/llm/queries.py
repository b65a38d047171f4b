"""The queries of this package by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, exact_dedup, mixing, passages, quality, secrets, simhash, spelling, toxicity, trie, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = trie.rebuilt(trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, members).drop("enter_at", "leave_at")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_mix": op12_source_mix,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The table of crc32 by bytes as a list, from its polynomial, and the crc32 of a list of bytes by it.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295)"


ORACLES = {
    "op2_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
            FROM pages),
        rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        ranked AS (
            SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS n
            FROM parts LEFT JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM ranked WHERE n = 1""",
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        w AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
    "op8_chat_format": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        said AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
                   '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS line
            FROM t),
        plain AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns, string_agg(line, '' ORDER BY pos) AS text, count(*) AS n_turns FROM said GROUP BY conv_id),
        heads AS (SELECT DISTINCT list_slice(turns, 1, i) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS i FROM plain)),
        firsts AS (SELECT turns, min(conv_id) AS conv_id FROM plain GROUP BY turns)
        SELECT conv_id, 0 AS part, n_turns, text FROM plain
        WHERE conv_id IN (SELECT conv_id FROM firsts WHERE turns NOT IN (SELECT turns FROM heads))""",
    "op11_prefix_trie": f"""
        WITH {CRC_TABLE},
        n AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS head, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM n), crc),
        said AS (
            SELECT c.conv_id, 0 AS side, pos, role, text FROM c JOIN n ON n.conv_id = head AND pos <= h
            UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN n ON n.conv_id = c.conv_id AND pos > h),
        built AS (
            SELECT c.conv_id, coalesce(any_value(turns), []) AS turns
            FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY side, pos) AS turns FROM said GROUP BY 1) s ON s.conv_id = c.conv_id GROUP BY 1),
        steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
        nodes AS (
            SELECT turns[1:depth] AS seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM steps GROUP BY 1, 2),
        kin AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]),
        kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY 1, 2),
        facts AS (
            SELECT kin.*, coalesce(n_children, 0) AS n_children, CASE WHEN kin.depth = 0 THEN 0 ELSE (n_convs - 1) * length(seq[kin.depth].text) END AS saved
            FROM kin LEFT JOIN kids ON kids.conv_id = kin.conv_id AND kids.depth = kin.depth),
        under AS (SELECT seq, n_children, saved, unnest(range(0, depth + 1)) AS k FROM facts),
        sums AS (SELECT seq[1:k] AS seq, k AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY 1, 2)
        SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM facts f JOIN sums s ON s.depth = f.depth AND s.seq = f.seq""",
    "op12_source_mix": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
        r AS (SELECT *, 2 * source_size AS most, 2 * source_size / weight AS ratio, sum(weight) OVER () AS heavy, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        l AS (SELECT *, sum(most) OVER w + ratio * (heavy - sum(weight) OVER w) < budget AS stops FROM r WINDOW w AS (ORDER BY ratio, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        level AS (SELECT (any_value(budget) - coalesce(sum(most) FILTER (stops), 0)::DOUBLE) / (any_value(heavy) - coalesce(sum(weight) FILTER (stops), 0))::DOUBLE AS level FROM l),
        t AS (SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM l, level),
        q AS (
            SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)))::BIGINT AS taken FROM q""",
    "op13_spelling_variants": f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 5 GROUP BY 1, 2),
        hashed AS (
            SELECT run, n, {crc_sql("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))")} AS h
            FROM runs, crc),
        words AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
        cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        longer AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = c.cut),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
            UNION SELECT word, n, other, other_n FROM longer UNION SELECT other, other_n, word, n FROM longer),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
        forms AS (
            SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form, CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
            FROM words LEFT JOIN best ON best.word = words.word),
        ways AS (SELECT word, word AS root FROM words UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL),
        roots AS (SELECT ways.word, root FROM ways JOIN forms ON forms.word = root WHERE forms.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
}
