"""The registered queries of the operators: thin digests over whole tables, with production parameters, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    found = media.digests(media.encode(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors_sha256")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import chat

    said = "</s>[INST] ok [/INST]"
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = told.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], told.schema))
    found = chat.read_back(chat.tree(both, path(chat.TOKENIZER)), path(chat.TOKENIZER))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import packing

    return packing.digests(packing.pack(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json")))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import lmscore

    return lmscore.score(_table(spark, sf_dir, "documents"), path(lmscore.VOCABULARY))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import htmlextract

    return htmlextract.extract(_table(spark, sf_dir, "pages"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.detect(docs, pii.train(docs)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import search
    from .common import written

    docs = _table(spark, sf_dir, "documents")
    documents, length = search.sizes(docs)
    segments = written(search.index(docs, documents, length), "segments")
    return search.search(segments, documents, _table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11_SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), z AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, z GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), z GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(ann.index(ann.nodes(vectors)), vectors.where("vec_id % 20 = 0"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie

    return trie.trie(trie.rebuilt(trie.sequences(_table(spark, sf_dir, "conversations"))))


#: crc32 of a decimal number bit by bit: each character is mixed in, then shifted eight times (-1 stands for a shift).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR,''), lambda x: [ascii(x)::BIGINT,-1,-1,-1,-1,-1,-1,-1,-1]))),
lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

OP13_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role,'') AS role, sha256(length(coalesce(role,'')) || ':' || coalesce(role,'') || coalesce(text,'')) AS name, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, name) AS pos FROM t),
ids AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, 0 AS part, pos, name, w FROM ids i JOIN o ON o.c = i.c - i.c % 20 AND pos <= h UNION ALL SELECT i.c, 1, pos, name, w FROM ids i JOIN o ON o.c = i.c AND pos > h),
p AS (SELECT c, row_number() OVER s AS depth, string_agg(name, '') OVER s AS path, w FROM r WINDOW s AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, '', 0 FROM ids),
n AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY depth, path),
l AS (SELECT *, path[:64*(depth-1)] AS parent, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.path[:64*n.depth] = n.path) AS n_children FROM n),
u AS (SELECT d AS depth, path[:64*d] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM l) GROUP BY 1, 2),
e AS (SELECT depth, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM p WHERE (c, depth) IN (SELECT c, max(depth) FROM p GROUP BY c) GROUP BY ALL)
SELECT l.conv_id, l.depth, CASE WHEN l.depth > 0 THEN a.conv_id END AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM l JOIN u ON u.depth = l.depth AND u.path = l.path LEFT JOIN n a ON a.depth = l.depth - 1 AND a.path = l.parent LEFT JOIN e ON e.depth = l.depth AND e.path = l.path"""


QUERIES = {f.__name__: f for f in (op1_neardup, op2_language, op3_packing, op4_chat, op5_audio, op6_lattice, op7_urls, op8_html, op9_decontam, op10_pii, op11_search, op12_ann, op13_trie, pipeline)}

ORACLES: dict[str, str] = {"op11_search": OP11_SEARCH, "op13_trie": OP13_TRIE}
