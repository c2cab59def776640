"""The registered queries of the language-model operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_decode
from .chat import chain, format_trees, read_back
from .decontaminate import find_contamination
from .lines import drop_frequent_lines
from .lm import score_texts
from .quality import quality_scores
from .ranked import search
from .scratch import Scratch
from .shards import assign_shards
from .simhash import near_duplicates
from .substring import remove_repeats
from .transducer import count_tokens
from .trie import numbered, prefix_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document: 3-word shingles, at most 3 bits."""
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, radius=3, seed=42)


def _sha256(text: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): lines of at least 10 documents go from all."""
    kept = drop_frequent_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; those with crc32 remainder 2 modulo 7 take no part in training."""
    return score_texts(_table(spark, sf_dir, "documents"), folds=7, held_out=2, deleted=3)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after removal of repeated windows of 35 words."""
    kept = remove_repeats(_table(spark, sf_dir, "documents"), width=35)
    return kept.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    coded = encode_decode(_table(spark, sf_dir, "documents"), vocabulary_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, shard, depth, part, bytes, shard_bytes, shard_rows): shards of at most 1 MiB of text."""
    return assign_shards(_table(spark, sf_dir, "documents"), limit=1 << 20)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, and one of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    made = read_back(format_trees(chain(rows), "conv_id", "node", "parent"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), _sha256(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), _sha256(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, held_out=0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) against windows of 10 words."""
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10, digest=True)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "n_items", "items_sha256", (hit > 0).alias("contaminated"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): 20 best inner products for ids divisible by 20."""
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; the limit is 4096 tokens."""
    counted = count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, doc_id, score): the 50 best documents of every benchmark item."""
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, role, text) and members (conv) of all conversations with the first turns of another.

    Conversation c takes the first h turns of c - c % 100, h = crc32(c) % 6, or all it has, and goes on
    with its own turns after its first h. Rows without an id belong to no conversation.
    """
    scratch = Scratch(conversations.sparkSession, "rebuilt")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv is not null")
    turns = scratch.write(numbered(rows, "conv", ["turn", "role", "text"], scratch), "turns")
    known = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    plan = known.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h"))
    lent = F.least("h", F.coalesce("n", F.lit(0)))
    plan = scratch.write(plan.join(known.withColumnRenamed("conv", "base"), "base", "left").select("conv", "base", "h", lent.alias("lent")), "plan")
    heads = turns.where("pos <= 5").select(F.col("conv").alias("base"), "pos", "role", "text")
    borrowed = plan.where("lent > 0").join(heads, "base").where("pos <= lent").select("conv", "pos", "role", "text")
    own = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "role", "text")
    return borrowed.union(own), plan.select("conv")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations, with its subtree's totals."""
    return prefix_trie(*rebuilt(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scores": op3_lm_scores,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_chat_format": op7_chat_format,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_token_counts": op11_token_counts,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_BLANK}), '{_UPPER}', '{_LOWER}') AS key
      FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
hot AS (SELECT key, TRUE AS hot FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (key) GROUP BY doc_id""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s FROM d, unnest(range(1, len(ws) - 33)) AS t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i, TRUE AS gone FROM rep, unnest(range(0, 35)) AS t(k)),
k AS (SELECT doc_id, count(*) AS n, count(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept
      FROM w LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
    "op6_extendible_shards": """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
u AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(h) = max(h) AS one_key
      FROM d, unnest(range(0, 61)) AS t(depth) GROUP BY ALL),
l AS (SELECT doc_id, bytes, h, min(depth) AS depth FROM d JOIN u ON u.prefix = d.h >> (60 - u.depth) AND (shard_bytes <= 1048576 OR one_key) GROUP BY ALL)
SELECT doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - l.depth)), l.depth::INTEGER, '0') END AS shard, l.depth::INTEGER AS depth,
       0::BIGINT AS part, bytes, shard_bytes, shard_rows
FROM l JOIN u ON u.depth = l.depth AND u.prefix = l.h >> (60 - l.depth)""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS body,
      length(role) AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(body + head + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS s
       FROM b, unnest(range(1, greatest(2, len(ws) - 8))) AS t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(ws) - n + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + k AS p FROM m, unnest(range(0, n)) AS t(k)) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op12_ranked_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*)::BIGINT AS big_n, sum(len(ws))::BIGINT AS big_l FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, len(ws)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, big_n),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), lambda a, b:
          list_reduce(list_prepend(xor(a, b), range(1, 9)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS a
        FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT c, c - c % 100 AS base, xor(a, 4294967295) % 6 AS h FROM crc),
ln AS (SELECT c, max(r) AS n FROM t GROUP BY c),
m AS (SELECT k.c, base, h, least(h, coalesce(n, 0)) AS lent FROM k LEFT JOIN ln ON ln.c = base),
b AS (SELECT m.c, t.r AS d, role, text FROM m JOIN t ON t.c = base AND t.r <= lent
      UNION ALL SELECT m.c, t.r - h + lent, role, text FROM m JOIN t ON t.c = m.c AND t.r > h),
e AS (SELECT c, d, text, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') OVER (PARTITION BY c ORDER BY d)) AS s FROM b),
x AS (SELECT c, d, text, s FROM e UNION ALL SELECT c, 0, '', '' FROM m),
y AS (SELECT c, d, text, min(c) OVER (PARTITION BY d, s) AS v, lead(c) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM x),
n AS (SELECT v, d, count(*) AS n_convs, max(length(text)) AS size, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM y GROUP BY v, d),
up AS (SELECT n.v, n.d, n_convs, size, ids, y.v AS parent FROM n LEFT JOIN y ON y.c = n.v AND y.d = n.d - 1),
kids AS (SELECT parent AS v, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
z AS (SELECT v, d, parent, n_convs, size, ids, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (v, d)),
sums AS (SELECT y.v, y.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM z JOIN y ON y.c = z.v AND y.d <= z.d GROUP BY y.v, y.d)
SELECT v AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
FROM z JOIN sums USING (v, d)""",
}
