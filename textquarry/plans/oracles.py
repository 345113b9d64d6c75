"""DuckDB SQL for the registered queries, written from the rules and not from the Spark code.

The pieces below build common table expressions: the word and sentence walks are recursive, the embedding is a table
of cells, a search is a join of cells. Texts that come from a chunk walk use ``WITH RECURSIVE``.
"""

from __future__ import annotations

from textquarry.operators.hits import INSTRUCTION

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}+', ' ', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def walk(name: str, rows: str, size: int = 1000, overlap: int = 200, least: int = 50) -> str:
    """CTEs ending in ``name(k, chunk, text)``: the word windows of ``rows`` (``SELECT … AS k, … AS t``)."""

    def stop(at: str) -> str:
        window = f"substr(t, {at} + 1, {size})"
        back = f"instr(reverse({window}), ' ')"
        return (
            f"CASE WHEN {at} + {size} < length(t) AND {back} > 0 AND {size} - {back} > 0 "
            f"THEN {at} + {size} - {back} ELSE {at} + {size} END"
        )

    return f"""
    {name}_n AS (SELECT k, {norm('t')} AS t FROM ({rows})),
    {name}_w(k, t, a, b) AS (
        SELECT k, t, 0, {stop('0')} FROM {name}_n WHERE length(t) > 0
        UNION ALL
        SELECT k, t, n, {stop('n')} FROM (
            SELECT k, t, CASE WHEN b - {overlap} > a THEN b - {overlap} ELSE a + {size - overlap} END AS n FROM {name}_w
        ) WHERE n < length(t)
    ),
    {name}_t AS (SELECT k, a, trim(substr(t, a + 1, b - a)) AS text FROM {name}_w),
    {name} AS (
        SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS INTEGER) AS chunk, text
        FROM {name}_t WHERE length(text) >= {least}
    )"""


DOCS = "SELECT doc_id AS k, text AS t FROM documents"
PATH = "'/corpus/' || source || '/' || doc_id || '.txt'"


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


# The documents as a chunk table: a collection per language.
CORPUS = f"""{walk('w', DOCS)},
    corpus AS (
        SELECT d.lang AS collection, md5(d.source || '::' || d.doc_id || '::' || w.chunk) AS id, w.text AS text,
               'file' AS source_type, d.source AS source, w.chunk AS chunk
        FROM w JOIN documents d ON d.doc_id = w.k
    ),
    names AS (SELECT DISTINCT lang AS name FROM documents),
    collections AS (SELECT name, 'hashed-words-256' AS embedding_model, 'texts in ' || name AS description FROM names)"""


def stats(chunks: str, collections: str) -> str:
    return f"""SELECT c.name, CAST(count(k.id) AS BIGINT) AS total_chunks,
        CAST(count(DISTINCT nullif(k.source, '')) AS BIGINT) AS total_sources, c.embedding_model, c.description
        FROM ({collections}) c LEFT JOIN ({chunks}) k ON k.collection = c.name
        GROUP BY c.name, c.embedding_model, c.description"""


SENTENCES = rf"""
    parts AS (
        SELECT doc_id AS k, list_filter(list_transform(
            string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'),
                '([.!?]){BLANK}+', '\1' || chr(1), 'g'), chr(1)),
            lambda s: {strip('s')}), lambda s: s <> '') AS s
        FROM documents
    )"""

_TAKE = "x.s[x.i + 1]"
_LONG = f"length({_TAKE}) > 1000"
_FULL = f"(len(x.g) > 0 AND list_sum(list_transform(x.g, lambda p: length(p) + 1)) + length({_TAKE}) + 1 > 1000)"
_KEPT = """len(list_filter(range(1, len(x.g) + 1), lambda j:
    list_sum(list_transform(x.g[len(x.g) - j + 1:], lambda p: length(p) + 1)) <= 200))"""

SENTENCE_CHUNKS = f"""{SENTENCES},
    fold(k, s, i, g, done) AS (
        SELECT k, s, 0, CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM parts WHERE len(s) > 0
        UNION ALL
        SELECT k, s, x.i + 1,
            CASE WHEN x.i = len(x.s) OR {_LONG} THEN CAST([] AS VARCHAR[])
                 WHEN {_FULL} THEN list_append(x.g[len(x.g) - {_KEPT} + 1:], {_TAKE})
                 ELSE list_append(x.g, {_TAKE}) END,
            CASE WHEN len(x.g) > 0 AND (x.i = len(x.s) OR {_LONG} OR {_FULL}) THEN array_to_string(x.g, ' ') END
        FROM fold x WHERE x.i <= len(x.s)
    ),
    longs AS (SELECT k, s, unnest(range(1, len(s) + 1)) AS i FROM parts),
    {walk('lw', "SELECT k * 1000000 + i AS k, s[i] AS t FROM longs WHERE length(s[i]) > 1000")},
    pieces AS (
        SELECT k, i AS a, -1 AS b, done AS text FROM fold WHERE length(done) >= 50
        UNION ALL
        SELECT k // 1000000, k % 1000000, chunk, text FROM lw
    )"""

# Nothing but tags, comments and four entities occurs in the pages.
_DROPPED = "script style nav footer head".split()


def page_text(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', chr(1), 'g')"
    for name in _DROPPED:
        out = rf"regexp_replace({out}, '(?is)<{name}(\s[^>]*)?>.*?</{name}\s*>', chr(1), 'g')"
    out = f"regexp_replace({out}, '(?s)<[/!?]?[A-Za-z][^>]*>', chr(1), 'g')"
    nodes = f"list_filter(list_transform(string_split({entities(out)}, chr(1)), lambda n: {strip('n')}), lambda n: n <> '')"
    return f"array_to_string({nodes}, ' ')"


def entities(text: str) -> str:
    for name, char in (("quot", "chr(34)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "chr(38)")):
        text = f"replace({text}, '&{name};', {char})"
    return text


def row_text(*columns: str) -> str:
    return "concat_ws(' | ', " + ", ".join(
        f"CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN '{c}: ' || {c} END" for c in columns
    ) + ")"


PART = row_text("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
ORDERS = row_text("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
CUSTOMER = row_text("c_name", "c_mktsegment", "c_acctbal")
LINEITEM = row_text(
    *"l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(),
    *"l_returnflag l_linestatus l_shipdate".split(),
)


def hash16(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


def row_chunks(rows: str, source: str) -> str:
    """Chunk rows of short texts: every one is a single chunk, normalised if it is long enough to be a window."""
    return f"""SELECT md5('sqlite::{source}::' || k || '::0') AS id, '{source}' AS source, CAST(k AS VARCHAR) AS row_id,
        CAST(0 AS INTEGER) AS chunk, CASE WHEN length({norm('t')}) >= 50 THEN {norm('t')} ELSE t END AS text,
        {hash16('t')} AS row_hash, CAST(1 AS INTEGER) AS n_chunks FROM ({rows}) WHERE t <> ''"""


# The labelled documents, those of quality 0 with another ending: the stored state of the incremental runs.
STORED = """SELECT d.doc_id AS k, CASE WHEN l.quality = 0 THEN d.text || ' x' ELSE d.text END AS t
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

CHANGES = f"""{walk('old', STORED)}, {walk('new', DOCS)},
    known AS (SELECT s.k, sha256(s.t) AS h FROM ({STORED}) s WHERE s.k IN (SELECT k FROM old)),
    judged AS (
        SELECT d.doc_id, {PATH} AS source, sha256(d.text) AS file_hash,
            CASE WHEN known.k IS NULL THEN 'new' WHEN known.h = sha256(d.text) THEN 'unchanged' ELSE 'changed' END AS change
        FROM documents d LEFT JOIN known ON known.k = d.doc_id
    ),
    counted AS (SELECT k, CAST(count(*) AS INTEGER) AS n FROM new GROUP BY k),
    outcomes AS (
        SELECT doc_id AS seq, doc_id || '.txt' AS name,
            CASE WHEN change = 'unchanged' OR n IS NULL THEN 'skipped' ELSE 'ingested' END AS status,
            CASE WHEN change = 'unchanged' THEN 'hash_match' WHEN n IS NULL THEN 'empty' END AS skip_reason,
            CAST(CASE WHEN change = 'unchanged' THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS n_chunks
        FROM judged LEFT JOIN counted ON counted.k = judged.doc_id
    )"""

TITLE_TAG = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"
PAGE_ROWS = f"SELECT page_id AS k, {page_text('html')} AS t, {strip(entities(TITLE_TAG))} AS title FROM pages"

# Some documents replaced by what is hard to read; JSON that cannot be read has no text.
POISON_ROWS = """SELECT doc_id AS k, CASE doc_id % 50 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.jsonl' ELSE '.md' END AS kind,
    CASE doc_id % 50 WHEN 0 THEN repeat('x', 200000) WHEN 1 THEN '' WHEN 2 THEN repeat('y', 60) ELSE text END AS t FROM documents"""
POISON = f"{walk('pw', POISON_ROWS)}, poison AS ({POISON_ROWS})"
KEYLESS = row_text("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

# Old chunks of unchanged documents and new chunks of all others: what an incremental run leaves.
AFTER = f"""{CHANGES},
    after AS (
        SELECT md5(j.source || '::' || n.chunk) AS id, j.source, n.chunk, md5(n.text) AS text_md5, j.file_hash
        FROM new n JOIN judged j ON j.doc_id = n.k
    )"""

OLD_ORDERS = f"""SELECT o_orderkey, {row_text('o_custkey', 'st', 'o_totalprice', 'o_orderdate', 'o_orderpriority').replace("'st: '", "'o_orderstatus: '")} AS t
    FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN '?' ELSE o_orderstatus END AS st
          FROM orders WHERE o_orderstatus <> 'O')"""

VECTORS = """
    pairs AS (
        SELECT q.vec_id AS qid, c.vec_id AS id, c.label AS label, 'label_' || c.label AS collection,
            round(greatest(list_inner_product(qv, qv) + list_inner_product(cv, cv) - 2 * list_inner_product(qv, cv), 0), 9) AS d
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings) q,
             (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS cv FROM embeddings) c
    )"""
SHOWN = "round(d, 4) AS distance, round(1 / (1 + d), 4) AS score"


def ranked(pairs: str, columns: str, by: str = "qid") -> str:
    return f"""SELECT qid, CAST(row_number() OVER (PARTITION BY {by} ORDER BY d, id) AS INTEGER) AS rank, id, {SHOWN}{columns}
        FROM {pairs}"""


def knn(where: str = "true", having: str = "rank <= 5") -> str:
    return f"WITH {VECTORS} SELECT * FROM ({ranked(f'(SELECT * FROM pairs WHERE {where})', ', label')}) WHERE {having}"


def merged(hits: str, names: list[str], columns: str = "", cut: str = "true") -> str:
    """Merge of ranked hits per collection: by rounded score, then caller order, then rank inside."""
    position = "list_position([" + ", ".join(f"'{n}'" for n in names) + "], collection)"
    return f"""SELECT * FROM (
        SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, {position}, rank) AS INTEGER) AS rank,
               collection, id, distance, score{columns} FROM ({hits})
    ) WHERE {cut}"""


# Sides of four hyperplanes; a query sees the buckets that differ from its own in at most two sides.
BUCKET = " + ".join(
    f"""CASE WHEN list_inner_product(v, list_transform(range(64), lambda i:
        CASE WHEN md5('{j}:' || i) < '8' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END)) >= 0 THEN {1 << j} ELSE 0 END"""
    for j in range(4)
)
PROBED = f"""WITH {VECTORS},
    buckets AS (SELECT vec_id, {BUCKET} AS b FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
    near AS (SELECT p.* FROM pairs p JOIN buckets x ON x.vec_id = p.qid JOIN buckets y ON y.vec_id = p.id
             WHERE bit_count(xor(x.b, y.b)) <= 2),
    short AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT qid FROM near GROUP BY qid HAVING count(*) >= 5)),
    seen AS (SELECT * FROM near WHERE qid NOT IN (SELECT vec_id FROM short)
             UNION ALL SELECT * FROM pairs WHERE qid IN (SELECT vec_id FROM short)),
    found AS (SELECT * FROM ({ranked('seen', '')}) WHERE rank <= 5),
    best AS (SELECT * FROM ({ranked('pairs', '')}) WHERE rank <= 5)"""

NAMED = ["label_7", "label_2", "unknown", "label_0"]
LANGS = ["fr", "en", "none", "de"]


def knn_merge(cut: str) -> str:
    inner = ranked("(SELECT * FROM pairs WHERE collection IN ('label_7', 'label_2', 'label_0'))", ", collection", "qid, collection")
    return f"WITH {VECTORS} " + merged(f"SELECT * FROM ({inner}) WHERE rank <= 5", NAMED, cut=cut)


def cells(name: str, rows: str) -> str:
    """CTE ``name(k, dim, weight)``: the hashed-words embedding of ``rows`` (``k, t``), weights as single floats."""
    return f"""
    {name}_c AS (
        SELECT k, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 256 AS dim, count(*) AS n
        FROM (SELECT k, unnest(string_split_regex(t, '[ \\n.,]+')) AS tok FROM ({rows})) WHERE tok <> '' GROUP BY ALL
    ),
    {name} AS (
        SELECT k, dim, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS weight FROM {name}_c
    ),
    {name}_s AS (SELECT k, sum(weight * weight) AS s FROM {name} GROUP BY k)"""


SEARCH = f"""{CORPUS},
    {cells('qc', 'SELECT item_id AS k, text AS t FROM benchmark')},
    {cells('cc', 'SELECT id AS k, text AS t FROM corpus')},
    dots AS (SELECT q.k AS qid, c.k AS id, sum(q.weight * c.weight) AS dot FROM qc q JOIN cc c ON q.dim = c.dim GROUP BY ALL),
    pairs AS (
        SELECT q.item_id AS qid, c.*, round(greatest(coalesce(qs.s, 0) + coalesce(cs.s, 0) - 2 * coalesce(dot, 0), 0), 9) AS d
        FROM benchmark q CROSS JOIN corpus c
        LEFT JOIN qc_s qs ON qs.k = q.item_id LEFT JOIN cc_s cs ON cs.k = c.id
        LEFT JOIN dots ON dots.qid = q.item_id AND dots.id = c.id
    ),
    hits AS (SELECT * FROM ({ranked('pairs', ', text, source, source_type, chunk')}) WHERE rank <= 5),
    many AS ({merged(
        "SELECT * FROM (" + ranked("(SELECT * FROM pairs WHERE collection IN ('fr', 'en', 'de'))",
                                   ", collection, text, source, chunk", "qid, collection") + ") WHERE rank <= 5 AND score >= 0.4",
        LANGS, ", text, source, chunk", "rank <= 5")}),
    shown AS (
        SELECT h.* EXCLUDE (source, source_type), b.text AS query_text,
            CASE WHEN source IN ('src1', 'src2') THEN 'sqlite' ELSE source_type END AS source_type,
            CASE WHEN source IN ('src1', 'src2') THEN '/data/shop.db::' || source
                 ELSE '/corpus/' || source || '.notes.md' END AS source
        FROM hits h JOIN benchmark b ON b.item_id = h.qid
    )"""

F3 = "printf('%.3f', CASE WHEN score * 16 = floor(score * 16) THEN score + 1e-7 ELSE score END)"
TITLE = r"regexp_extract(source, '[^/\\]*$')"
KEY = rf"regexp_replace(regexp_replace({TITLE}, '\.[^.]+$', ''), '[^a-zA-Z0-9]+', '_', 'g') || '_' || (rank - 1)"
SCORE = r"regexp_replace(CAST(CAST(score AS DECIMAL(9,4)) AS VARCHAR), '\.?0+$', '')"


def line(text: str) -> str:
    return f"replace({text}, chr(10), ' ')"


def exported(entry: str, separator: str, head: str = "''") -> str:
    return f"""{recursive(SEARCH)} SELECT qid, any_value({head}) || string_agg({entry}, {separator} ORDER BY rank) AS content
        FROM shown GROUP BY qid"""


def text_search(body: str) -> str:
    return f"{recursive(SEARCH)} {body}"


def corpus_sql(body: str) -> str:
    return f"{recursive(CORPUS)} {body}"


NL = "chr(10)"
SAFE = r"""substr(regexp_replace(query_text, '[\\/:*?"<>|]+', '_', 'g'), 1, 80)"""
VAULT = f"'Search — ' || {SAFE} || ' — 2024-06-30 (' || qid || ')/'"


def yaml(text: str) -> str:
    return line(f"replace({text}, chr(34), chr(92) || chr(34))")


_PLAIN = "SELECT k AS doc_id, chunk, text FROM w"

ORACLES: dict[str, str] = {
    "chunk_words": f"{recursive(walk('w', DOCS))} {_PLAIN}",
    "chunk_words_small": f"{recursive(walk('w', DOCS, 200, 40, 20))} {_PLAIN}",
    "chunk_sentences": f"""{recursive(SENTENCE_CHUNKS)}
        SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS INTEGER) AS chunk, text FROM pieces""",
    "sentence_split": f"""WITH {SENTENCES}
        SELECT k AS doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS position, unnest(s) AS sentence FROM parts""",
    "chunk_ids": f"""{recursive(walk('w', DOCS))}
        SELECT d.doc_id, w.chunk, md5(d.source || '/' || d.doc_id || '.txt::' || w.chunk) AS relative_id,
            md5({PATH} || '::' || w.chunk) AS absolute_id,
            md5('sqlite::/data/corpus.db::documents::' || d.doc_id || '::' || w.chunk) AS row_chunk_id
        FROM w JOIN documents d ON d.doc_id = w.k""",
    "content_hash": f"SELECT doc_id, sha256(text) AS content_hash, {hash16('text')} AS row_hash FROM documents",
    "duplicate_groups": "SELECT sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "source_names": r"""SELECT page_id, lower(regexp_extract(url, '[^/\\](\.[^./\\]+)$', 1)) AS suffix,
        regexp_extract(url, '[^/\\]*$') AS basename,
        regexp_replace(regexp_replace(regexp_extract(url, '[^/\\]*$'), '\.[^.]+$', ''), '[^a-zA-Z0-9]+', '_', 'g')
            || '_' || page_id AS cite_key,
        url AS existence_key FROM pages""",
    "html_text": f"SELECT page_id, {page_text('html')} AS text FROM pages",
    "html_title": rf"""SELECT page_id, {strip(entities(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title,
        '' AS author FROM pages""",
    "json_flatten": "SELECT event_id, json_extract_string(props, '$.k') AS text FROM events",
    "row_text_default": f"""SELECT CAST(p_partkey AS VARCHAR) AS row_id, t AS text, {hash16('t')} AS row_hash
        FROM (SELECT p_partkey, {PART} AS t FROM part)""",
    "row_text_columns": f"""SELECT CAST(c_custkey AS VARCHAR) AS row_id, t AS text, {hash16('t')} AS row_hash
        FROM (SELECT c_custkey, {CUSTOMER} AS t FROM customer)""",
    "row_text_template": f"""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, t AS text, {hash16('t')} AS row_hash
        FROM (SELECT o_orderkey, coalesce(o_orderstatus, '') || ': ' || coalesce(o_orderpriority, '') || ' ('
              || coalesce(CAST(o_totalprice AS VARCHAR), '') || ')' AS t FROM orders)""",
    "scan_folder": "SELECT source, doc_id, lang, md5(text) AS text_md5 FROM documents",
    "scan_path_list": f"""SELECT CASE WHEN l.quality = 0 THEN replace({PATH}, '.txt', '.bin') ELSE {PATH} END AS path,
        CASE WHEN l.doc_id IS NULL THEN 'extract_error: file not found'
             WHEN l.quality = 0 THEN 'extract_error: unsupported format' END AS skip_reason
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""".replace("|| doc_id ||", "|| d.doc_id ||"),
    "scan_jsonl": "SELECT concat_ws(' ', doc_id, lang, source, text) AS text FROM documents",
    "scan_csv": "SELECT concat_ws(', ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) AS text FROM part",
    "scan_rows": """SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS copy FROM lineitem""",
    "scan_csv_ragged": """SELECT replace(translate(text, chr(10) || chr(13) || '" ', '  ,,'), ',', ', ') AS text FROM conversations""",
    "html_text_hard": f"""SELECT page_id, 'hello' || CASE WHEN t = '' THEN '' ELSE ' ' || t END AS text
        FROM (SELECT page_id, {page_text('html')} AS t FROM pages)""",
    "ingest_poison": f"""{recursive(POISON)} SELECT p.k || p.kind AS name,
            CASE WHEN p.kind = '.json' THEN 'error' WHEN c.n IS NULL THEN 'skipped' ELSE 'ingested' END AS status,
            CASE WHEN p.kind = '.json' THEN 'extract_error: invalid JSON' WHEN c.n IS NULL THEN 'empty' END AS skip_reason,
            coalesce(c.n, 0) AS n_chunks
        FROM poison p LEFT JOIN (SELECT k, CAST(count(*) AS INTEGER) AS n FROM pw GROUP BY k) c ON c.k = p.k""",
    "ingest_rows_null_ids": row_chunks(
        f"SELECT k, max(t) AS t FROM (SELECT coalesce(CAST(nullif(o_custkey % 50, 0) AS VARCHAR), 'None') AS k, {KEYLESS} AS t FROM orders) GROUP BY k",
        "shop::orders",
    ),
    "knn_multi_blocked": f"WITH {VECTORS} "
    + merged(
        "SELECT * FROM ("
        + ranked(
            "(SELECT qid, id, label, 'a' AS collection, d FROM pairs UNION ALL SELECT qid, id, label + 100, 'b', d FROM pairs)",
            ", collection, label",
            "qid, collection",
        )
        + ") WHERE rank <= 5",
        ["b", "a"],
        ", label",
        "rank <= 5",
    ),
    "scan_collection": corpus_sql("SELECT id, source, chunk FROM corpus WHERE collection = 'de'"),
    "extract_mixed": f"""
        SELECT '/pages/' || page_id || '.HTML' AS path, md5({page_text('html')}) AS text_md5,
            {strip(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS doc_title,
            CAST(NULL AS VARCHAR) AS error FROM pages
        UNION ALL SELECT '/docs/' || doc_id || '.md', md5(text), '', NULL FROM documents
        UNION ALL SELECT '/events/' || event_id || '.json', md5(json_extract_string(props, '$.k')), '', NULL FROM events
        UNION ALL SELECT '/turns/' || conv_id || '-' || turn || '.jsonl', md5(role || chr(10) || turn || ' ' || conv_id || ' ' || text), '', NULL
            FROM conversations""",
    "extract_archives": f"""SELECT doc_id, md5(coalesce(array_to_string(
            list_filter(string_split(text, chr(10)), lambda p: {strip('p')} <> ''), chr(10)), '')) AS text_md5,
        '' AS doc_title, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "incremental_files": f"{recursive(CHANGES)} SELECT source, file_hash, change FROM judged",
    "incremental_rows": f"""SELECT CAST(o.o_orderkey AS VARCHAR) AS row_id, {hash16('n')} AS row_hash,
            CASE WHEN s.t IS NULL THEN 'new' WHEN s.t = n THEN 'unchanged' ELSE 'changed' END AS change
        FROM (SELECT o_orderkey, {ORDERS} AS n FROM orders) o LEFT JOIN ({OLD_ORDERS}) s ON s.o_orderkey = o.o_orderkey""",
    "ingest_incremental": f"""{recursive(AFTER)} SELECT * FROM after""",
    "ingest_rows": f"""SELECT id, row_id, row_hash, text, n_chunks
        FROM ({row_chunks(f'SELECT o_orderkey AS k, {ORDERS} AS t FROM orders', 'shop::orders')})""",
    "page_chunks": f"""{recursive(walk('pc', PAGE_ROWS))}
        SELECT '/pages/' || pc.k || '.html' AS source, pc.chunk, r.title AS doc_title, '' AS doc_author, '' AS doc_created, md5(pc.text) AS text_md5
        FROM pc JOIN ({PAGE_ROWS}) r ON r.k = pc.k""",
    "where_sources_table": corpus_sql("""SELECT id, source, chunk FROM corpus WHERE source IN
        (SELECT source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1)"""),
    "row_ingest": row_chunks(f"SELECT p_partkey AS k, {PART} AS t FROM part", "shop::part"),
    "row_ingest_short": row_chunks(f"SELECT n_nationkey AS k, {row_text('n_name', 'n_regionkey')} AS t FROM nation", "shop::nation")
    + " UNION ALL "
    + row_chunks(f"SELECT r_regionkey AS k, {row_text('r_name')} AS t FROM region", "shop::region"),
    "row_ingest_no_id": f"""SELECT source, chunk, text, row_hash, n_chunks
        FROM ({row_chunks(f"SELECT '' AS k, {LINEITEM} AS t FROM lineitem", 'shop::lineitem')})""",
    "mixed_collection": f"""{recursive(walk('w', DOCS))}
        SELECT 'all' AS collection, 'file' AS source_type, count(*) AS chunks, count(DISTINCT k) AS sources FROM w
        UNION ALL SELECT 'all', 'sqlite', count(*), 1 FROM supplier""",
    "upsert_chunks": f"""{recursive(AFTER)},
        stored AS (SELECT md5({PATH} || '::' || o.chunk) AS id, {PATH} AS source, o.chunk, md5(o.text) AS text_md5
                   FROM old o JOIN documents d ON d.doc_id = o.k)
        SELECT coalesce(a.id, s.id) AS id, coalesce(a.source, s.source) AS source, coalesce(a.chunk, s.chunk) AS chunk,
            coalesce(a.text_md5, s.text_md5) AS text_md5
        FROM after a FULL OUTER JOIN stored s ON s.id = a.id""",
    "orphan_ids": f"""{recursive(walk('s', DOCS, 200, 40, 20), walk('w', DOCS))}
        SELECT md5({PATH} || '::' || s.chunk) AS id FROM s JOIN documents d ON d.doc_id = s.k
        LEFT JOIN (SELECT k, count(*) AS n FROM w GROUP BY k) c ON c.k = s.k WHERE s.chunk >= coalesce(c.n, 0)""",
    "ingest_outcomes": f"{recursive(CHANGES)} SELECT * FROM outcomes",
    "ingest_summary": f"""{recursive(CHANGES)} SELECT count(*) AS sources_found,
        count(*) FILTER (status = 'ingested') AS sources_ingested, count(*) FILTER (status <> 'ingested') AS sources_skipped,
        CAST(coalesce(sum(n_chunks) FILTER (status = 'ingested'), 0) AS BIGINT) AS chunks_stored FROM outcomes""",
    "skip_reasons": f"""{recursive(CHANGES)},
        r AS (SELECT seq, name || ': ' || skip_reason AS line, row_number() OVER (ORDER BY seq) AS n
              FROM outcomes WHERE skip_reason IS NOT NULL),
        c AS (SELECT seq, CASE WHEN n <= 500 THEN line ELSE '(truncated — more than 500 skipped entries)' END AS line
              FROM r WHERE n <= 501)
        SELECT CAST(count(*) AS INTEGER) AS listed, coalesce(string_agg(line, chr(10) ORDER BY seq), '') AS reasons FROM c""",
    "ingest_progress": f"""{recursive(CHANGES)} SELECT seq, name AS filename, row_number() OVER (ORDER BY seq) AS files_done,
        count(*) OVER () AS files_total, status, CAST(sum(n_chunks) OVER (ORDER BY seq) AS BIGINT) AS chunks_stored
        FROM outcomes""",
    "sources": corpus_sql("SELECT DISTINCT source FROM corpus WHERE source <> ''"),
    "source_counts": corpus_sql("SELECT source, count(*) AS chunks FROM corpus WHERE source <> '' GROUP BY source"),
    "collection_stats": corpus_sql(stats("SELECT * FROM corpus", "SELECT * FROM collections")),
    "list_collections": "SELECT DISTINCT lang AS name FROM documents",
    "embedding_models": "SELECT DISTINCT 'hashed-words-256' AS embedding_model FROM documents",
    "create_collection": """SELECT DISTINCT lang AS name, 'hashed-words-256' AS embedding_model, 'texts in ' || lang AS description
        FROM documents UNION ALL SELECT 'notes', 'hashed-words-256', ''""",
    "model_mismatches": """SELECT DISTINCT lang AS name, 'hashed-words-256' AS embedding_model, 'another-model' AS requested_model
        FROM documents WHERE lang = 'en'""",
    "describe_collection": """SELECT DISTINCT lang AS name, 'hashed-words-256' AS embedding_model,
        CASE WHEN lang = 'fr' THEN 'French texts' ELSE 'texts in ' || lang END AS description FROM documents""",
    "rename_collection": corpus_sql(
        stats(
            "SELECT * REPLACE (CASE WHEN collection = 'en' THEN 'english' ELSE collection END AS collection) FROM corpus",
            "SELECT * REPLACE (CASE WHEN name = 'en' THEN 'english' ELSE name END AS name) FROM collections",
        )
    ),
    "reset_collection": corpus_sql(
        stats("SELECT * FROM corpus WHERE collection <> 'es'", "SELECT * FROM collections WHERE name <> 'es'")
    ),
    "delete_source": corpus_sql(
        """SELECT collection, source, count(*) AS chunks FROM corpus
        WHERE NOT (collection = 'en' AND source = 'src3') GROUP BY ALL"""
    ),
    "delete_sources": corpus_sql(
        """SELECT collection, source, count(*) AS chunks FROM corpus
        WHERE NOT (collection = 'en' AND source IN ('src0', 'src1')) GROUP BY ALL"""
    ),
    "deletion_counts": corpus_sql(
        """SELECT s.source, count(c.id) AS chunks_deleted
        FROM (SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1')) s
        LEFT JOIN corpus c ON c.source = s.source AND c.collection = 'en' GROUP BY s.source"""
    ),
    "purge_stale": corpus_sql(
        """SELECT count(*) AS chunks_checked, count(*) FILTER (source IN ('src3', 'src7')) AS chunks_deleted FROM corpus"""
    ),
    "purge_kept": corpus_sql(
        "SELECT source, count(*) AS chunks FROM corpus WHERE source NOT IN ('src3', 'src7') GROUP BY source"
    ),
    "where_eq": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr'",
    "where_in": "SELECT doc_id, lang, source, n_chars FROM documents WHERE source IN ('src2', 'src5', 'src11')",
    "where_and_or": """SELECT doc_id, lang, source, n_chars FROM documents
        WHERE (lang = 'de' OR n_chars >= 5000) AND source NOT IN ('src1', 'src2') AND n_chars < 20000""",
    "where_range": "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 200 AND n_chars <= 900 AND lang <> 'en'",
    "source_search": "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')",
    "labelled_filter": """SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE l.toxic IS DISTINCT FROM 1 AND l.quality = 1""",
    "result_defaults": f"""SELECT id, text, '' AS source, 'file' AS source_type, chunk, '' AS doc_title, '' AS doc_author,
        '' AS doc_created FROM ({row_chunks(
            f"SELECT s_suppkey AS k, {row_text('s_name', 's_nationkey', 's_acctbal')} AS t FROM supplier", "shop::supplier")})""",
    "knn_exact": knn(),
    "knn_blocked": knn(),
    "knn_filtered": knn("label NOT IN (2, 7)"),
    "knn_min_score": knn(having="rank <= 5 AND score >= 0.44"),
    "knn_multi": knn_merge("rank <= 5"),
    "knn_multi_union": knn_merge("true"),
    "knn_lsh": f"{PROBED} SELECT * FROM found",
    "knn_lsh_recall": f"""{PROBED} SELECT b.qid, count(f.id) AS found, count(*) AS wanted
        FROM best b LEFT JOIN found f ON f.qid = b.qid AND f.id = b.id GROUP BY b.qid""",
    "knn_ivf_recall": f"""WITH {VECTORS}, best AS (SELECT * FROM ({ranked('pairs', '')}) WHERE rank <= 5)
        SELECT count(DISTINCT qid) AS queries, count(*) AS wanted, true AS reached FROM best""",
    "embed_hash": f"""WITH {cells('x', DOCS)}
        SELECT k AS doc_id, CAST(dim AS INTEGER) AS dim, round(weight, 6) AS weight FROM x""",
    "search_text": text_search("SELECT * FROM hits"),
    "search_collection": text_search(
        f"""SELECT * FROM ({ranked("(SELECT * FROM pairs WHERE collection = 'en' AND source IN ('src1', 'src2', 'src3'))",
                                   ", text, source, source_type, chunk")}) WHERE rank <= 5"""
    ),
    "search_text_many": text_search("SELECT * EXCLUDE (text) FROM many"),
    "answer_context": text_search(
        f"""SELECT qid, context, 'Reply in English.' || {NL} || {NL} || '{INSTRUCTION}' || {NL} || {NL} || 'CONTEXT:'
            || {NL} || context AS prompt
        FROM (SELECT qid, string_agg(text, {NL} || {NL} ORDER BY rank) AS context FROM hits GROUP BY qid)"""
    ),
    "answer_context_many": text_search(
        f"SELECT qid, string_agg(text, {NL} || {NL} ORDER BY rank) AS context FROM many GROUP BY qid"
    ),
    "cited_sources": text_search(
        """SELECT qid, rank, source, score FROM hits
        QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY rank) = 1"""
    ),
    "hit_neighbours": text_search(
        """SELECT qid, rank, id, coalesce(lag(id) OVER o, id) AS previous_id, coalesce(lead(id) OVER o, id) AS next_id
        FROM hits WINDOW o AS (PARTITION BY qid ORDER BY rank)"""
    ),
    "export_json": text_search(
        """SELECT qid, '[' || string_agg(CAST(json_object('text', text, 'source', source, 'chunk', chunk) AS VARCHAR), ','
            ORDER BY rank) || ']' AS content FROM shown GROUP BY qid"""
    ),
    "export_csv": exported(
        f"""{SCORE} || ',"' || replace(source, '"', '""') || '",' || chunk || ',"' || {line("replace(text, '\"', '\"\"')")} || '"'""",
        NL,
        f"'score,source,chunk,text' || {NL}",
    ),
    "export_markdown": exported(
        f"'## ' || rank || '. ' || {TITLE} || ' (score: ' || {F3} || ')' || {NL} || {NL} || text || {NL}",
        f"{NL} || '---' || {NL} || {NL}",
        f"'# Query Results' || {NL} || {NL} || '**Query:** ' || query_text || {NL} || {NL}",
    ),
    "export_bibtex": exported(
        rf"""'@misc{{' || {KEY} || ',' || {NL} || '  title       = {{' || {TITLE} || '}},' || {NL}
        || '  note        = {{Score: ' || {F3} || '; Query: ' || regexp_replace(query_text, '[{{}}]', '', 'g') || '}},' || {NL}
        || '  annotation  = {{' || substr(regexp_replace(regexp_replace(text, '[{{}}]', '', 'g'), '\s+', ' ', 'g'), 1, 500)
        || '}},' || {NL} || '  year        = {{2024}}' || {NL} || '}}'""",
        f"{NL} || {NL}",
    ),
    "export_ris": exported(
        f"""'TY  - GEN' || {NL} || 'TI  - ' || {TITLE} || {NL} || 'AB  - ' || substr({line('text')}, 1, 2000) || {NL}
        || 'N1  - Semantic search; score ' || {F3} || '; query "' || {line('query_text')} || '"' || {NL} || 'PY  - 2024' || {NL}
        || CASE WHEN source_type = 'sqlite' THEN 'N1  - SQLite source: ' ELSE 'UR  - ' END || source || {NL} || 'ER  - '""",
        f"{NL} || {NL}",
    ),
    "export_csl": text_search(
        f"""SELECT qid, '[' || string_agg(CAST(json_object('id', {KEY}, 'type', 'document', 'title', {TITLE},
            'abstract', substr(text, 1, 2000), 'note', 'score=' || {F3} || '; query=' || query_text,
            'issued', json_object('date-parts', [[2024]]), 'URL', source) AS VARCHAR), ',' ORDER BY rank) || ']' AS content
        FROM shown GROUP BY qid"""
    ),
    "export_vault": text_search(
        f"""SELECT qid, {VAULT} || 'README.md' AS path, '# ' || {SAFE} || {NL} || {NL} || 'Exported on 2024-06-30.'
            || {NL} || {NL} || '## Results' || {NL} || string_agg('- [[' || {KEY} || ']] — ' || source, {NL} ORDER BY rank) AS content
        FROM shown GROUP BY qid, query_text
        UNION ALL
        SELECT qid, {VAULT} || {KEY} || '.md', '---' || {NL} || 'source: "' || {yaml('source')} || '"' || {NL} || 'score: ' || {F3}
            || {NL} || 'chunk: ' || chunk || {NL} || 'query: "' || {yaml('query_text')} || '"' || {NL} || '---' || {NL} || {NL} || text
        FROM shown"""
    ),
    "export_answer": text_search(
        f"""SELECT qid, '# Answer' || {NL} || {NL} || '**Query:** ' || any_value(query_text) || {NL}
            || '**Provider:** local · digest' || {NL} || {NL} || '## Answer' || {NL} || {NL}
            || md5(max(text) FILTER (rank = 1)) || {NL} || {NL} || '## Sources' || {NL} || {NL}
            || string_agg('### ' || rank || '. ' || {TITLE} || ' (score: ' || {F3} || ')' || {NL} || {NL} || text,
                          {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS content
        FROM shown GROUP BY qid"""
    ),
    "recent_distinct": """SELECT user_id, event_type, last_used, CAST(position AS INTEGER) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, event_type) AS position
        FROM (SELECT user_id, event_type, max(ts) AS last_used FROM events GROUP BY ALL)) WHERE position <= 3""",
    "throttle_window": """SELECT event_type AS folder, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS emitted_at,
        count(*) AS changes, count(DISTINCT event_id) AS paths FROM events GROUP BY ALL""",
    "throttle_stream": """SELECT event_type AS folder, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS emitted_at,
        count(*) AS changes, count(DISTINCT event_id) AS paths FROM events GROUP BY ALL""",
    "stream_ingest": f"""{recursive(AFTER)} SELECT id, source, chunk, text_md5 FROM after""",
    "store_replay": f"""{recursive(AFTER)} SELECT a.* FROM after a WHERE a.source NOT LIKE '/corpus/src4/%'""",
}
