"""The registered queries of the language-model operators, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, language_id, line_dedup, names, packing, pii, repeats, sentencepieces, token_counts, token_files, treaps
from .exact_dedup import exact_dedup
from .shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The key under which this catalogue's query permutes; a caller of the operator brings its own.
DEMONSTRATION_KEY = "marlstone demonstration key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    return found.select("doc_id", "text", "n_finds", F.array_join("finds.kind", " ").alias("kinds"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=0)
    return packed.rows.drop("ids")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), names.folded("name").alias("name"))
    vendors = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("id"), names.folded(names.misspelt("name", "vendor_id")).alias("name"))
    found = names.near_names(clients, vendors)
    return found.select(F.col("id").alias("vendor_id"), "distance", F.col("n").alias("n_clients"), F.col("first_id").alias("first_client_id"), F.col("crc").alias("clients_crc"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_repeats": op3_repeats,
    "op4_jaccard": op4_jaccard,
    "op6_decontaminate": op6_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op7_token_files": op7_token_files,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_packing": op11_packing,
    "op12_ranked": op12_ranked,
    "op13_names": op13_names,
}


def _crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII text: a step for each bit."""
    steps = f"flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split({text}, '')])"
    step = "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}::BIGINT[]), {step}), 4294967295::BIGINT)"


def _folded_sql(name: str) -> str:
    return f"translate({name}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms_sql() -> str:
    return r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % _folded_sql("coalesce(text, '')")


ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op12_ranked": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql()} AS t FROM documents),
        n AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
        a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
        q AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text, unnest({_terms_sql()}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
        i AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)) AS i FROM p JOIN n USING (r), a),
        s AS (SELECT item_id, q.text, n.doc_id, sum(c * w * i)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) JOIN n USING (r) GROUP BY item_id, q.text, r, n.doc_id),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20""",
    "op13_names": f"""
        WITH RECURSIVE
        c AS (SELECT client_id, {_folded_sql("name")} AS name, {_crc32_sql("client_id::VARCHAR")} AS crc FROM clients WHERE name <> ''),
        h AS (SELECT vendor_id, name, {_crc32_sql("vendor_id::VARCHAR")} AS h FROM vendors WHERE name <> ''),
        p AS (SELECT *, CASE WHEN h % 2 = 0 AND length(name) > 1 THEN (h % (length(name) - 1))::INT END AS p FROM h),
        v AS (SELECT DISTINCT vendor_id, {_folded_sql("CASE WHEN p IS NULL THEN name ELSE left(name, p) || substr(name, p + 2, 1) || substr(name, p + 1, 1) || substr(name, p + 3) END")} AS name FROM p),
        pairs AS (SELECT a.name AS a, b.name AS b FROM (SELECT DISTINCT name FROM c) a JOIN (SELECT DISTINCT name FROM v) b
                  ON abs(length(a.name) - length(b.name)) <= 2),
        d AS (  -- a cell of the matrix at each step: its row so far, and the two rows above; until two rows have no cell of 2
            SELECT a, b, 1 AS i, 0 AS j, []::BIGINT[] AS two, range(length(b) + 1) AS one, [1]::BIGINT[] AS now FROM pairs
            UNION ALL
            SELECT a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END,
                   CASE WHEN j = length(b) THEN one ELSE two END, CASE WHEN j = length(b) THEN now ELSE one END,
                   CASE WHEN j = length(b) THEN [i + 1]::BIGINT[] ELSE list_append(now, least(one[j + 2] + 1, now[j + 1] + 1, one[j + 1] + (a[i] <> b[j + 1])::BIGINT,
                       CASE WHEN i > 1 AND j > 0 AND a[i] = b[j] AND a[i - 1] = b[j + 1] THEN two[j] + 1 ELSE 99 END)) END
            FROM d WHERE j < length(b) OR i < length(a) AND least(list_min(now), list_min(one)) <= 2),
        near AS (SELECT a, b, now[length(b) + 1] AS distance FROM d WHERE i = length(a) AND j = length(b) AND now[length(b) + 1] <= 2)
        SELECT vendor_id, distance::INT AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, sum(crc)::BIGINT AS clients_crc
        FROM v JOIN near ON v.name = b JOIN c ON c.name = a GROUP BY vendor_id, distance""",
}
