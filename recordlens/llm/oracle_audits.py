"""DuckDB SQL for the operators that audit whole tables: decontamination, source divergence, Merkle manifest."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def decontamination(window: int = 10) -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS uid, {_matches('text', words)} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_matches('text', words)} AS w FROM benchmark),
        cut AS (SELECT item, w, least({window}, len(w)) AS n FROM i WHERE len(w) > 0),
        windows AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS words
              FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM cut)),
        grams AS (SELECT uid, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
              FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS p
                    FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        hits AS MATERIALIZED (SELECT * FROM grams JOIN windows USING (n, words)),
        covered AS (SELECT uid, count(DISTINCT x) AS n_hit
                    FROM (SELECT uid, unnest(range(p, p + n)) AS x FROM hits) GROUP BY uid),
        met AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                FROM (SELECT DISTINCT uid, item FROM hits WHERE item IS NOT NULL) GROUP BY uid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (uid) LEFT JOIN met USING (uid)"""


def divergence(least_docs: int = 3, most: int = 200) -> str:
    words = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

    def share(n: str, size: str) -> str:
        return f"1 + (1000000000 * (CAST({n} AS HUGEINT) + 1)) // ({size} + v)"

    f = "((p - q) * (p - q)) // q"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang,
              coalesce(source, '') AS source, {_matches('text', words)} AS w FROM documents),
        w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
        c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, sum(total) AS lang_size, count(*) AS v FROM k GROUP BY lang),
        g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(s.size), 0) AS size, coalesce(any_value(lang_size), 0) AS lang_size,
              coalesce(any_value(v), 0) AS v FROM d LEFT JOIN (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL) s USING (lang, source)
              LEFT JOIN l ON l.lang = d.lang GROUP BY ALL),
        p AS MATERIALIZED (SELECT g.lang, g.source, k.term, {share('coalesce(c.n, 0)', 'size')} AS p
              FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        own AS (SELECT c.lang, c.source, c.term, {share('c.n', 'size')} AS p, {share('total', 'lang_size')} AS q
              FROM c JOIN g ON g.lang = c.lang AND g.source = c.source JOIN k ON k.lang = c.lang AND k.term = c.term),
        every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, {f} FROM own WHERE p > q),
        ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
              CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {most}"""


def _levels(base: str, tree: str, name: str, levels: int) -> tuple[list[str], str]:
    """Tables of ``levels`` levels over ``base(tree, i, d)``, and the expression of a node's list of runs."""
    out = [f"{name}0 AS MATERIALIZED (SELECT {tree}, i, d, count(*) OVER (PARTITION BY {tree}) AS n FROM {base})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT {tree}, i // 8 AS i, list(d ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n
                FROM (SELECT {tree}, i, sha256(array_to_string(run, '')) AS d FROM {name}r{k}
                      UNION ALL SELECT {tree}, i, d FROM {name}{k} WHERE n = 1))"""
        )
    return out, f"{name}{levels}"


def merkle(levels: int = 8) -> str:
    """Up to ``8 ** levels`` documents a language, and as many languages."""

    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value})) || ':' || {value} END"

    def leaf(text: str) -> str:
        names = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return f"sha256({' || '.join(field(n) for n in names)})"

    crc = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
    low, low_end = _levels("leaves", "t", "a", levels)
    up, up_end = _levels("subroots", "z", "b", levels)
    # Every level adds the siblings to the proof and folds the digest into the run's.
    steps, before, place = [], "leaves", "i"
    for k in range(levels):
        own = f"CAST(s.{place} // {8**k} % 8 AS BIGINT)"
        steps.append(
            f"""p{k} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN run IS NULL THEN proof ELSE proof ||
                array_to_string(run[1:{own}], '') || array_to_string(run[{own} + 2:], '') END AS proof,
                CASE WHEN run IS NULL THEN found ELSE sha256(array_to_string(run[1:{own}], '') || found ||
                array_to_string(run[{own} + 2:], '')) END AS found)
                FROM {before if k else '(SELECT *, CAST(NULL AS VARCHAR) AS x, CAST(0 AS BIGINT) AS z FROM leaves)'} s
                LEFT JOIN ar{k} r ON r.t = s.t AND r.i = s.i // {8 ** (k + 1)})"""
        )
        before = f"p{k}"
    for k in range(levels):
        own = f"CAST(s.t // {8**k} % 8 AS BIGINT)"
        steps.append(
            f"""q{k} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN run IS NULL THEN proof ELSE proof ||
                array_to_string(run[1:{own}], '') || array_to_string(run[{own} + 2:], '') END AS proof,
                CASE WHEN run IS NULL THEN found ELSE sha256(array_to_string(run[1:{own}], '') || found ||
                array_to_string(run[{own} + 2:], '')) END AS found)
                FROM {before} s LEFT JOIN br{k} r ON r.i = s.t // {8 ** (k + 1)})"""
        )
        before = f"q{k}"
    return f"""WITH hashed AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS d,
              CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents),
        leaves AS MATERIALIZED (SELECT doc_id, d, coalesce(altered, d) AS found, '' AS proof,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
              dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM hashed),
        {', '.join(low)},
        subroots AS (SELECT 0 AS z, t AS i, d FROM {low_end}),
        {', '.join(up)},
        {', '.join(steps)}
        SELECT doc_id, s.d AS leaf, e.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, found AS folded_root,
               found = r.d AS verified
        FROM {before} s JOIN {low_end} e ON e.t = s.t, {up_end} r"""


def sql() -> dict[str, str]:
    return {
        "op11_decontamination": decontamination(),
        "op12_source_divergence": divergence(),
        "op13_merkle_manifest": merkle(),
    }
