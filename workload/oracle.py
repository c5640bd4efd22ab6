"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from recordlens.functions.text import WHITESPACE
from workload.catalog import LOOKUP_ID, QUERY, QUERY_VECTOR, TOP
from workload.inputs import CUT, EDIT_URL

DIM = 64


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def clean(x: str) -> str:
    s = strip(x)
    missing = f"{x} IS NULL OR lower({s}) IN ('', 'nan', 'none', 'null')"
    return f"CASE WHEN {missing} THEN '' ELSE {s} END"


def text_of(title: str, tags: str, body: str) -> str:
    parts = ", ".join(f"nullif({clean(x)}, '')" for x in (title, tags, body))
    return f"concat_ws(' ', {parts})"


def link_of(url: str, link: str) -> str:
    chosen = f"coalesce(CASE WHEN {strip(url)} <> '' THEN {url} END, {link}, '')"
    bogus = "('0', '0.0', '0.0.0.0', 'nan', 'None')"
    return f"CASE WHEN {strip(chosen)} IN {bogus} THEN '' ELSE {chosen} END"


def number_of(x: str) -> str:
    pattern = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    return f"CASE WHEN regexp_matches({strip(x)}, '{pattern}') THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def normalized(x: str) -> str:
    s = strip(x)
    digits = f"regexp_full_match(replace({s}, '.0', ''), '[0-9]+')"
    return f"CASE WHEN {s} LIKE '%.0' AND {digits} THEN left({s}, length({s}) - 2) ELSE {s} END"


def dot(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    )


def norm(v: str) -> str:
    return f"sqrt({dot(v, v)})"


def keyword(q: str, wid: str, title: str, body: str) -> str:
    return (
        f"(CASE WHEN {q} <> '' AND {q} = {wid} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        f" + CASE WHEN {q} <> '' AND contains(lower({title}), lower({q})) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
        f" + CASE WHEN {q} <> '' AND contains(lower({body}), lower({q})) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
    )


def final(semantic: str, kw: str) -> str:
    return f"(0.75::DOUBLE * {semantic} + 0.25::DOUBLE * {kw})"


RAW = """raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS body,
         lang AS tags, source AS link FROM documents)"""

LINKED = """raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS body,
         lang AS tags, source AS link, url FROM documents LEFT JOIN pages ON page_id = doc_id)"""

REVISED_SOURCE = """
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         split_part(text || coalesce(chr(10) || 'quality ' || quality, ''), chr(10), 1) AS title,
         text || coalesce(chr(10) || 'quality ' || quality, '') AS body, lang AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT 'page-' || page_id, url, html, NULL FROM pages"""


def cleaned(source: str = "raw", name: str = "rec", more: str = "", null_title: bool = False) -> str:
    """Common table expression ``name`` with the cleaned rows of ``source``."""
    title = f"coalesce({strip('title')}, '')"
    body = f"coalesce({strip('body')}, '')"
    body = f"CASE WHEN {body} = '' THEN {title} ELSE {body} END"
    keep = "id IS NOT NULL" + ("" if null_title else " AND title IS NOT NULL")
    return f"""{name} AS (
  SELECT * FROM (SELECT {normalized('id')} AS id, {title} AS title, {body} AS body {more}
                 FROM {source} WHERE {keep}) WHERE id <> '' AND body <> '')"""


def print_of(wid: str = "id", title: str = "title", body: str = "body") -> str:
    return f"sha256({wid} || '|' || {title} || '|' || {body})"


def hashed(source: str, name: str = "vec") -> str:
    """Common table expressions that end in ``name(id, v)``, unit token-hash vectors of text."""
    return f"""{name}_sums AS (
  SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIM} AS b,
         sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END) AS s
  FROM (SELECT id, unnest(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+')) AS t
        FROM {source}) WHERE t <> '' GROUP BY ALL),
{name}_dense AS (
  SELECT g.id, list(CAST(coalesce(s.s, 0) AS DOUBLE) ORDER BY g.b) AS v
  FROM (SELECT id, b FROM {source}, range({DIM}) AS r(b)) g
  LEFT JOIN {name}_sums s ON s.id = g.id AND s.b = g.b GROUP BY g.id),
{name} AS (
  SELECT id, list_transform(v, lambda x: CAST(x / n AS FLOAT)) AS v
  FROM (SELECT id, v, greatest({norm('v')}, 1e-12) AS n FROM {name}_dense))"""


def entries(source: str, key: str, out: str, v: str = "v") -> str:
    return f"""SELECT {key} AS {out}, CAST(i AS INTEGER) AS pos,
       CAST({v}[CAST(i AS INTEGER) + 1] AS DOUBLE) AS weight
FROM {source}, range({DIM}) AS r(i)"""


NONZERO = "CAST(len(list_filter(v, lambda x: x <> 0)) AS INTEGER)"

RECORDS = f"{RAW}, {cleaned(more=', tags, link')}"

HASH_INDEX = f"""{RECORDS},
src AS (SELECT id, {text_of('title', 'tags', 'body')} AS txt FROM rec), {hashed('src')}"""

PRINTS = f"""{RAW}, {cleaned()},
old AS (SELECT id, {print_of()} AS fp FROM rec)"""

REVISED = f"""{PRINTS}, rev_raw AS ({REVISED_SOURCE}), {cleaned('rev_raw', 'rev')},
new AS (SELECT id, title, body, {print_of()} AS fp FROM rev)"""

DIFF = f"""{REVISED}, diff AS (
  SELECT new.id, new.fp, CASE WHEN old.id IS NULL THEN 'new' WHEN old.fp <> new.fp THEN 'modified'
         ELSE 'unchanged' END AS status FROM new LEFT JOIN old ON old.id = new.id)"""

LAST = "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"

FEED = f"""state AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_type AS title, props AS body, ts,
         {print_of('CAST(user_id AS VARCHAR)', 'event_type', 'props')} AS fp
  FROM (SELECT *, {LAST} AS n FROM events WHERE ts <= TIMESTAMP '{CUT}') WHERE n = 1),
incoming AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_type AS title, props AS body, ts,
         {print_of('CAST(user_id AS VARCHAR)', 'event_type', 'props')} AS fp
  FROM (SELECT *, {LAST} AS n FROM events WHERE ts > TIMESTAMP '{CUT}') WHERE n = 1),
touched AS (
  SELECT i.*, s.id IS NULL AS is_new FROM incoming i LEFT JOIN state s ON s.id = i.id
  WHERE s.id IS NULL OR s.fp <> i.fp),
upserted AS (
  SELECT id, title, body, ts, fp FROM state WHERE id NOT IN (SELECT id FROM touched)
  UNION ALL SELECT id, title, body, ts, fp FROM touched),
stats AS (
  SELECT count(*) FILTER (WHERE is_new) AS added, count(*) FILTER (WHERE NOT is_new) AS updated,
         (SELECT count(*) FROM events WHERE ts > TIMESTAMP '{CUT}') - count(*) AS skipped
  FROM touched)"""

CORPUS = f"""{LINKED}, {cleaned(more=', tags, link, url')},
corpus AS (SELECT rec.*, embedding AS v, {print_of()} AS fp
           FROM rec JOIN embeddings ON CAST(vec_id AS VARCHAR) = id)"""

HYBRID = f"""{CORPUS},
scored AS (
  SELECT CAST(id AS BIGINT) AS work_item_id, title, {link_of('url', 'link')} AS link,
         {dot('q.embedding', 'v')} AS semantic_score,
         {keyword(f"'{QUERY}'", 'id', 'title', 'body')} AS keyword_score
  FROM corpus, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VECTOR}) q),
top AS (
  SELECT *, {final('semantic_score', 'keyword_score')} AS final_score
  FROM scored ORDER BY final_score DESC, work_item_id LIMIT {TOP})"""


def presented(source: str) -> str:
    clamped = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, final_score))"
    best = f"max({clamped}) OVER ()"
    share = f"CASE WHEN {best} > 0 THEN least(100.0::DOUBLE, {clamped} / {best} * 100.0) ELSE 0.0 END"
    return f"""SELECT CAST(row_number() OVER (ORDER BY final_score DESC, work_item_id, title) AS INTEGER) AS rank,
       printf('%.1f%%', {share}) AS match, * FROM {source}"""


def searched(query: str, k: int) -> str:
    """Common table expressions ending in ``hits``: hybrid search in the token-hash index."""
    return f"""{HASH_INDEX},
qsrc AS (SELECT 'q' AS id, '{query}' AS txt), {hashed('qsrc', 'qvec')},
hits AS (
  SELECT *, {final('semantic_score', 'keyword_score')} AS final_score FROM (
    SELECT CAST(rec.id AS BIGINT) AS work_item_id, title, {link_of('NULL', 'link')} AS link,
           {dot('qvec.v', 'vec.v')} AS semantic_score,
           {keyword(f"'{query}'", 'rec.id', 'title', 'body')} AS keyword_score
    FROM rec JOIN vec ON vec.id = rec.id, qvec)
  ORDER BY final_score DESC, work_item_id LIMIT {k})"""


MIXED = """CASE event_type WHEN 'error' THEN json_k || '.5%' WHEN 'view' THEN json_k
  WHEN 'click' THEN 'Item ' || json_k ELSE '' END"""
JSON_K = "regexp_extract(props, '\"k\": *([0-9]+)', 1)"


def sql() -> dict[str, str]:
    return {
        "scan_records": f"""WITH {RAW} SELECT id AS work_item_id, title,
            nullif({clean('tags')}, '') AS tags, link, CAST(length(body) AS INTEGER) AS chars
            FROM raw""",
        "incremental_pull": f"""SELECT CAST(user_id AS VARCHAR) AS work_item_id,
            event_type AS title, event_id AS seq FROM events WHERE ts > TIMESTAMP '{CUT}'""",
        "fingerprint_json_load": f"""SELECT event_id, 'k' AS work_item_id,
            {JSON_K} AS fingerprint FROM events WHERE {JSON_K} <> ''""",
        "workbook_links": f"""SELECT doc_id AS work_item_id,
            CASE WHEN url IS NULL THEN '{EDIT_URL}' || doc_id ELSE {strip('url')} END AS link
            FROM documents LEFT JOIN pages ON page_id = doc_id""",
        "publish_snapshot": f"""WITH {RECORDS} SELECT id AS work_item_id, title,
            {print_of()} AS fingerprint FROM rec""",
        "published_vectors": f"WITH {HASH_INDEX} {entries('vec', 'id', 'work_item_id')}",
        "snapshot_refresh": f"""WITH {DIFF},
            touched AS (SELECT * FROM new JOIN diff USING (id) WHERE status <> 'unchanged'),
            rows AS (SELECT id, title, body, fp, id IN (SELECT id FROM touched) AS changed FROM old
                     JOIN (SELECT id, title, body FROM rec) USING (id) WHERE id NOT IN (SELECT id FROM touched)
                     UNION ALL SELECT id, title, body, new.fp, true FROM new WHERE id IN (SELECT id FROM touched)),
            src AS (SELECT rows.id, {text_of('title', 'tags', 'body')} AS txt FROM rows
                    LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS tags FROM documents) t USING (id)), {hashed('src')}
            SELECT rows.id AS work_item_id, title, fp AS fingerprint, {NONZERO} AS nonzero,
            (SELECT count(*) FROM diff WHERE status = 'new') AS new,
            (SELECT count(*) FROM diff WHERE status = 'modified') AS modified,
            (SELECT count(*) FROM diff WHERE status = 'unchanged') AS unchanged
            FROM rows JOIN vec ON vec.id = rows.id""",
        "export_csv": """SELECT CAST(doc_id AS VARCHAR) AS work_item_id,
            nullif(split_part(text, chr(10), 1), '') AS title, source AS link FROM documents""",
        "fingerprint_json_dump": f"WITH {PRINTS} SELECT id AS work_item_id, fp AS fingerprint FROM old",
        "fingerprint_merge": f"""WITH {REVISED} SELECT coalesce(old.id, new.id) AS work_item_id,
            coalesce(new.fp, old.fp) AS fingerprint
            FROM old FULL JOIN new ON new.id = old.id""",
        "build_index": f"""WITH {HASH_INDEX} SELECT rec.id AS work_item_id, title,
            nullif({clean('tags')}, '') AS tags, CAST(length(body) AS INTEGER) AS chars,
            {print_of('rec.id')} AS fingerprint, CAST(len(v) AS INTEGER) AS dim,
            {NONZERO} AS nonzero FROM rec JOIN vec ON vec.id = rec.id""",
        "schema_check": """SELECT 'work_item_id' AS column_name, true AS present,
            count(doc_id) AS filled_rows FROM documents
            UNION ALL SELECT 'title', true, count(text) FROM documents
            UNION ALL SELECT 'bug_url', false, 0""",
        "clean_records": f"""WITH src AS (
            SELECT CASE WHEN l.doc_id IS NOT NULL THEN ' ' || d.doc_id || '.0' END AS id,
                   split_part(text, chr(10), 1) AS title,
                   substr(text, length(split_part(text, chr(10), 1)) + 2) AS body
            FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), {cleaned('src')}
            SELECT id AS work_item_id, title, body AS semantic_text FROM rec""",
        "normalize_id": f"""SELECT event_id, raw_id, {normalized('raw_id')} AS work_item_id
            FROM (SELECT event_id, ' ' || user_id || CASE event_type WHEN 'error' THEN '.0'
                  WHEN 'view' THEN '.00' WHEN 'click' THEN '.0.0' ELSE '' END || chr(10) AS raw_id
                  FROM events)""",
        "exact_lookup": f"""WITH {LINKED}, {cleaned(more=', link, url')}
            SELECT CAST(id AS BIGINT) AS work_item_id, title, {link_of('url', 'link')} AS link,
            1.0::DOUBLE AS semantic_score, 1.0::DOUBLE AS keyword_score,
            1.0::DOUBLE AS final_score FROM rec WHERE id = '{LOOKUP_ID}'""",
        "changed_rows": f"""WITH {DIFF} SELECT new.id AS work_item_id, title,
            CAST(length(body) AS INTEGER) AS chars FROM new JOIN diff ON diff.id = new.id
            WHERE status <> 'unchanged'""",
        "url_repair": f"""WITH {LINKED} SELECT id AS work_item_id,
            CASE WHEN coalesce({strip('url')}, '') = '' THEN '{EDIT_URL}' || id ELSE url END
            AS bug_url FROM raw""",
        "url_repair_count": f"""WITH {LINKED} SELECT count(*) AS repaired FROM raw
            WHERE coalesce({strip('url')}, '') = ''""",
        "url_repair_file": f"""WITH {LINKED}, fixed AS (SELECT *, coalesce({strip('url')}, '') = '' AS missing FROM raw)
            SELECT id AS work_item_id, nullif(title, '') AS title,
            CASE WHEN missing THEN '{EDIT_URL}' || id ELSE url END AS bug_url,
            (SELECT count(*) FROM fixed WHERE missing) AS repaired FROM fixed""",
        "link_choice": f"""WITH {LINKED} SELECT id AS work_item_id,
            {link_of('url', 'link')} AS link FROM raw""",
        "link_clean": f"""SELECT event_id, CASE WHEN {JSON_K} IN ('0', '') THEN ''
            ELSE {JSON_K} END AS link FROM events""",
        "corpus_join": f"""WITH {CORPUS} SELECT id AS work_item_id, title, url AS bug_url,
            fp AS fingerprint, CAST(len(v) AS INTEGER) AS dim,
            list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))) AS vector_sum FROM corpus""",
        "corpus_left_out": f"""WITH {RECORDS}
            SELECT id AS work_item_id, 'vector' AS missing FROM rec ANTI JOIN embeddings ON CAST(vec_id AS VARCHAR) = id
            UNION ALL SELECT CAST(vec_id AS VARCHAR), 'record' FROM embeddings ANTI JOIN rec ON CAST(vec_id AS VARCHAR) = id""",
        "row_alignment": """SELECT
            (SELECT count(*) FROM documents) AS record_rows,
            (SELECT count(*) FROM embeddings) AS vector_rows,
            (SELECT count(*) FROM documents ANTI JOIN embeddings ON vec_id = doc_id)
              AS records_without_vector,
            (SELECT count(*) FROM embeddings ANTI JOIN documents ON vec_id = doc_id)
              AS vectors_without_record,
            (SELECT count(*) FROM (
               (SELECT doc_id FROM documents EXCEPT ALL SELECT vec_id FROM embeddings)
               UNION ALL
               (SELECT vec_id FROM embeddings EXCEPT ALL SELECT doc_id FROM documents))) = 0
              AS aligned""",
        "link_augment": f"""WITH {LINKED} SELECT id AS work_item_id, title,
            coalesce({strip('url')}, '') AS link FROM raw""",
        "link_job": f"""WITH {LINKED} SELECT id AS work_item_id, title,
            CASE WHEN url IS NULL THEN '{EDIT_URL}' || id ELSE {strip('url')} END AS link FROM raw""",
        "link_job_kept": f"""WITH {RAW} SELECT id AS work_item_id, title,
            CASE WHEN tags = 'en' AND link IS NOT NULL THEN 'https://host/' || link ELSE '' END AS link FROM raw""",
        "hyperlink_formula": """SELECT doc_id, CASE
            WHEN lang = 'en' THEN 'https://host/edit/' || doc_id
            WHEN lang = 'fr' THEN 'https://host/a,b&c/edit/' || doc_id
            ELSE 'https://host/a,b&c/edit/r' || doc_id END AS url FROM documents""",
        "shared_formula": """SELECT doc_id,
            'HYPERLINK("https://host/edit/"&$A' || (doc_id + 2) || ',"row")' AS formula
            FROM documents""",
        "shared_formula_reused": """SELECT doc_id, 'HYPERLINK("https://host/' ||
            last_value(CASE WHEN doc_id = first OR doc_id % 7 = 0 THEN doc_id END IGNORE NULLS) OVER
              (PARTITION BY source ORDER BY doc_id) || '/"&$A' || (doc_id + 2) || ',"row")' AS formula
            FROM (SELECT *, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)""",
        "vector_norm": f"SELECT vec_id, {norm('embedding')} AS norm FROM embeddings",
        "is_normalized": f"""SELECT bool_and(abs({norm('embedding')} - 1) <= 1e-3)
            AS is_normalized FROM embeddings""",
        "dim_check": """SELECT CAST(min(len(embedding)) AS INTEGER) AS min_dim,
            CAST(max(len(embedding)) AS INTEGER) AS max_dim,
            min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings""",
        "l2_normalize": f"""WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(e * CAST(label AS FLOAT) AS FLOAT))
            AS v FROM embeddings), y AS (SELECT vec_id, list_transform(v, lambda e:
            CAST(CAST(e AS DOUBLE) / n AS FLOAT)) AS v FROM (SELECT *, greatest({norm('v')}, 1e-12)
            AS n FROM x)) {entries('y', 'vec_id', 'vec_id')}""",
        "renormalize_index": f"""WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(e * CAST(label AS FLOAT) AS FLOAT))
            AS v FROM embeddings), y AS (SELECT vec_id, CASE WHEN abs(n0 - 1) <= 1e-3 THEN v
            ELSE list_transform(v, lambda e: CAST(CAST(e AS DOUBLE) / n AS FLOAT)) END AS v
            FROM (SELECT *, {norm('v')} AS n0, greatest({norm('v')}, 1e-12) AS n FROM x))
            {entries('y', 'vec_id', 'vec_id')}""",
        "hash_embed": f"WITH {HASH_INDEX} {entries('vec', 'id', 'work_item_id')}",
        "keyword_score": f"""WITH {RECORDS} SELECT id AS work_item_id,
            {keyword("'The'", 'id', 'title', 'body')} AS keyword_score FROM rec""",
        "cosine_topk": f"""SELECT vec_id, label, {dot('q.v', 'embedding')} AS score
            FROM embeddings, (SELECT embedding AS v FROM embeddings WHERE vec_id = {QUERY_VECTOR}) q
            ORDER BY score DESC, vec_id LIMIT {TOP}""",
        "hybrid_topk": f"WITH {HYBRID} SELECT * FROM top",
        "batch_topk": f"""WITH {HASH_INDEX},
            qraw AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS txt FROM benchmark),
            {hashed('qraw', 'qvec')},
            pairs AS (
              SELECT qraw.id AS query_id, CAST(rec.id AS BIGINT) AS work_item_id, title,
                {dot('qvec.v', 'vec.v')} AS semantic_score,
                {keyword(strip('qraw.txt'), 'rec.id', 'title', 'body')} AS keyword_score
              FROM qraw JOIN qvec ON qvec.id = qraw.id, rec JOIN vec ON vec.id = rec.id),
            ranked AS (
              SELECT *, row_number() OVER (PARTITION BY query_id
                ORDER BY final_score DESC, work_item_id) AS rank
              FROM (SELECT *, {final('semantic_score', 'keyword_score')} AS final_score FROM pairs))
            SELECT query_id, CAST(rank AS INTEGER) AS rank, work_item_id, title, semantic_score,
            keyword_score, final_score FROM ranked WHERE rank <= 5""",
        "match_pct": f"""WITH {HYBRID}, shown AS ({presented('top')})
            SELECT rank, match, work_item_id, title FROM shown""",
        "search_front": f"""WITH {searched('error in the', 5)}, shown AS ({presented('hits')})
            SELECT rank, match, work_item_id, title, link, final_score FROM shown""",
        "index_counts": f"""WITH {FEED} SELECT count(*) AS total_indexed,
            strftime(max(ts), '%d %b %Y %I:%M %p') AS last_indexed,
            any_value(added) AS added, any_value(updated) AS updated, any_value(skipped) AS skipped
            FROM upserted, stats""",
        "pull_refresh": f"""WITH {FEED},
            known AS (SELECT count(*) AS n FROM events WHERE ts = (SELECT max(ts) FROM state))
            SELECT id AS work_item_id, title, body AS semantic_text, fp AS fingerprint, added, updated,
            skipped + known.n AS skipped FROM upserted, stats, known""",
        "exact_front": f"""WITH {RECORDS}, hits AS (
            SELECT CAST(id AS BIGINT) AS work_item_id, title, {link_of('NULL', 'link')} AS link,
            1.0::DOUBLE AS final_score FROM rec WHERE id = '{LOOKUP_ID}'), shown AS ({presented('hits')})
            SELECT rank, match, work_item_id, title, link, final_score FROM shown""",
        "refresh_stats": f"WITH {FEED} SELECT added, updated, skipped FROM stats",
        "index_upsert": f"""WITH {FEED},
            src AS (SELECT id, {text_of('title', 'NULL', 'body')} AS txt FROM upserted),
            {hashed('src')}
            SELECT upserted.id AS work_item_id, title, body AS semantic_text, fp AS fingerprint,
            CAST(ts AS VARCHAR) AS changed_at, {NONZERO} AS nonzero
            FROM upserted JOIN vec ON vec.id = upserted.id""",
        "snapshot_diff": f"""WITH {DIFF} SELECT id AS work_item_id, fp AS fingerprint, status
            FROM diff""",
        "snapshot_diff_counts": f"""WITH {DIFF} SELECT
            count(*) FILTER (WHERE status = 'new') AS new,
            count(*) FILTER (WHERE status = 'modified') AS modified,
            count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
            count(*) FILTER (WHERE status <> 'unchanged') > 0 AS changed FROM diff""",
        "dedupe_first": """SELECT user_id, event_type AS "Title", props AS "SemanticText",
            event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""",
        "dedupe_last": f"""SELECT user_id, event_type AS "Title", props AS "SemanticText",
            event_id AS seq FROM (SELECT *, {LAST} AS n FROM events) WHERE n = 1""",
        "fingerprint_audit": f"""WITH {PRINTS}, rev_raw AS ({REVISED_SOURCE}),
            cur AS (SELECT {strip('id')} AS plain, {normalized('id')} AS id,
                    coalesce({strip('title')}, '') AS title, coalesce({strip('body')}, '') AS body
                    FROM rev_raw),
            fps AS (SELECT *, sha256(plain || title || body) AS plain_hash,
                    {print_of()} AS hash FROM cur)
            SELECT plain AS plain_id, fps.id AS work_item_id, plain_hash, hash,
            a.id IS NOT NULL AS plain_id_known, coalesce(a.fp = plain_hash, false) AS plain_matches,
            b.id IS NOT NULL AS id_known, coalesce(b.fp = hash, false) AS matches
            FROM fps LEFT JOIN old a ON a.id = plain LEFT JOIN old b ON b.id = fps.id""",
        "strip_text": f"SELECT page_id, {strip('html')} AS text FROM pages",
        "clean_text": f"""SELECT conv_id, turn,
            CASE WHEN role = 'user' THEN '' ELSE {clean('text')} END AS text FROM conversations""",
        "embedding_text": f"""SELECT doc_id, t AS text, CAST(length(t) AS INTEGER) AS chars FROM (
            SELECT doc_id, {text_of("split_part(text, chr(10), 1)", "nullif(lang, 'en')", 'text')}
            AS t FROM documents)""",
        "fingerprint": f"""SELECT doc_id,
            {print_of('CAST(doc_id AS VARCHAR)', 'source', 'text')} AS fingerprint FROM documents""",
        "id_to_int": f"""SELECT event_id, raw_id, coalesce(
            CASE WHEN regexp_full_match(raw_id, '[0-9]+') THEN TRY_CAST(raw_id AS BIGINT) END,
            TRY_CAST(trunc({number_of('raw_id')}) AS BIGINT), 0) AS id
            FROM (SELECT event_id, CASE event_type WHEN 'error' THEN user_id || '.' || {JSON_K}
                  WHEN 'view' THEN '-' || user_id || 'e1' WHEN 'click' THEN event_type || user_id
                  ELSE CAST(user_id AS VARCHAR) END AS raw_id FROM events)""",
        "display_sort": f"""SELECT event_id, value_text,
            CASE WHEN value_text = '' THEN 2 WHEN num IS NOT NULL THEN 0 ELSE 1 END AS sort_class,
            num AS sort_number,
            CASE WHEN value_text <> '' AND num IS NULL THEN lower(value_text) ELSE '' END AS sort_text
            FROM (SELECT event_id, value_text,
                  {number_of("rtrim(value_text, '%')")} AS num
                  FROM (SELECT event_id, {MIXED} AS value_text
                        FROM (SELECT *, {JSON_K} AS json_k FROM events)))""",
        "display_positions": f"""WITH keyed AS (SELECT event_id, value_text,
            CASE WHEN value_text = '' THEN 2 WHEN num IS NOT NULL THEN 0 ELSE 1 END AS sort_class,
            num AS sort_number,
            CASE WHEN value_text <> '' AND num IS NULL THEN lower(value_text) ELSE '' END AS sort_text
            FROM (SELECT event_id, value_text,
                  {number_of("rtrim(value_text, '%')")} AS num
                  FROM (SELECT event_id, {MIXED} AS value_text
                        FROM (SELECT *, {JSON_K} AS json_k FROM events))))
            SELECT event_id, value_text, row_number() OVER (ORDER BY sort_class DESC, sort_number DESC NULLS LAST,
            sort_text DESC, value_text DESC, event_id) - 1 AS position FROM keyed""",
        "diagnostics_report": _diagnostics(),
        "stream_refresh": f"""SELECT CAST(user_id AS VARCHAR) AS work_item_id,
            event_type AS title, props AS semantic_text,
            {print_of('CAST(user_id AS VARCHAR)', 'event_type', 'props')} AS fingerprint
            FROM (SELECT *, {LAST} AS n FROM events) WHERE n = 1""",
    }


def _diagnostics() -> str:
    return f"""WITH {searched('test error', 1)},
        d AS (SELECT count(*) AS n FROM documents),
        e AS (SELECT count(*) AS n, max(len(embedding)) AS dim,
              bool_and(abs({norm('embedding')} - 1) <= 1e-3) AS unit FROM embeddings),
        report AS (
        SELECT 'Metadata loaded + schema valid' AS name, true AS ok,
               'records: ' || n AS message FROM d
        UNION ALL SELECT 'Embeddings loaded', true, n || ' vectors of ' || dim || ' numbers' FROM e
        UNION ALL SELECT 'Row alignment', d.n = e.n,
               e.n || ' vectors for ' || d.n || ' records' FROM d, e
        UNION ALL SELECT 'Embeddings have unit length', unit,
               CASE WHEN unit THEN 'all' ELSE 'some are not' END FROM e
        UNION ALL SELECT 'Refresh state readable', true,
               'refreshed at ' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') FROM events
        UNION ALL SELECT 'Sample semantic search', true,
               'best match: ' || work_item_id FROM hits)
        SELECT *, (SELECT bool_and(ok) FROM report) AS overall_ok FROM report"""
