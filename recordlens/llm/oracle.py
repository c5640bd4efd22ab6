"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from recordlens.llm.quality_rules import PHRASES, WORDS_A_PHRASE_WORD
from recordlens.llm.url_filters import MARGIN

WORD = r"'[^\x20\x09-\x0D]+'"
SPACE = r"'[\x20\x09-\x0D]+'"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, {WORD})"


def _word_chars(text: str) -> str:
    return f"length(regexp_replace({text}, {SPACE}, '', 'g'))"


def _quality(max_loss: float = 0.5) -> str:
    runs = " + ".join(f"len(regexp_extract_all(l, '[{c}]+'))" for c in "#*$%&|<>")
    held = " + ".join(f"CASE WHEN contains(lower(l), '{p}') THEN {len(p.split())} ELSE 0 END" for p in PHRASES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, {_words('t')} AS w,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM d),
        grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
        often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM
                    (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM often WHERE n > 1) GROUP BY doc_id),
        lines AS (SELECT doc_id, l, len({_words('l')}) AS n, length(l) - length(replace(l, '|', '')) AS bars,
                  {runs} AS marks, {held} AS held, (length(l) - length(replace(l, '!!', ''))) // 2 AS shouts
                  FROM (SELECT doc_id, unnest(lines) AS l FROM w)),
        removed AS (SELECT doc_id, sum({_word_chars('l')}) AS n FROM lines
                    WHERE (bars >= 3 AND bars * 4 >= n) OR marks + shouts > CAST(0.3 AS DOUBLE) * n OR (held > 0 AND {WORDS_A_PHRASE_WORD} * held >= n)
                    GROUP BY doc_id),
        counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_word_chars('t')} AS BIGINT) AS word_chars,
                   CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                   CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_chars
                   FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)),
        judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
        SELECT *, NOT base_failed AND n_removed_chars <= CAST({max_loss} AS DOUBLE) * word_chars AS kept FROM judged"""


def _near_vectors(threshold: float = 0.98) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {threshold}),
        reach(id, root) AS (SELECT vec_id, vec_id FROM v
                            UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.root),
        named AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id,
               v.vec_id = component_id AS kept FROM v JOIN named ON named.id = v.vec_id"""


def _urls(rules, threshold: float = 0.5, damping: float = 0.85, iterations: int = 60) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    link = r"""'(?is)\bhref\s*=\s*["'']?([^"''\s>]+)'"""
    link_host = r"'(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)'"
    rule, verdict = "CASE", "CASE"
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        domain, slash, rest = r.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}')"
        rule += f" WHEN {fits} THEN '{r}'"
        verdict += f" WHEN {fits} THEN '{v}'"
    steps, d = [], f"CAST({damping} AS DOUBLE)"
    for k in range(1, iterations + 1):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT host, trust_seed, distrust_seed,
            trust_seed + {d} * coalesce(t, 0) AS trust,
            distrust_seed + (1 - distrust_seed) * {d} * coalesce(b, 0) AS distrust
            FROM s{k - 1}
            LEFT JOIN (SELECT dst AS host, sum(trust * share) AS t FROM edges JOIN s{k - 1} ON host = src GROUP BY dst)
                USING (host)
            LEFT JOIN (SELECT src AS host, sum(distrust * share) AS b FROM edges JOIN s{k - 1} ON host = dst GROUP BY src)
                USING (host))""")
    return f"""WITH p AS MATERIALIZED (SELECT page_id, html,
            translate(regexp_extract(coalesce(url, ''), {parts}, 1), '{upper}', '{lower}') AS host,
            regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages),
        j AS MATERIALIZED (SELECT *, {rule} END AS rule, {verdict} END AS by_rule FROM p),
        l AS (SELECT host AS src, translate(regexp_extract(h, {link_host}, 1), '{upper}', '{lower}') AS dst
              FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), {link}, 1)) AS h FROM p)),
        c AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
        edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM c),
        seeds AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0 END) AS trust_seed,
              avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0 END) AS distrust_seed
              FROM j WHERE host <> '' GROUP BY host),
        s0 AS MATERIALIZED (SELECT host, coalesce(trust_seed, 0) AS trust_seed, coalesce(distrust_seed, 0) AS distrust_seed,
              coalesce(trust_seed, 0) AS trust, coalesce(distrust_seed, 0) AS distrust
              FROM seeds FULL JOIN (SELECT src AS host FROM c UNION SELECT dst FROM c) USING (host)),
        {', '.join(steps)}
        SELECT page_id, host, path, rule, coalesce(by_rule,
            CASE WHEN distrust > {threshold} AND distrust > trust + {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN s{iterations} USING (host)"""


def sql(rules) -> dict[str, str]:
    return {"op1_url_filters": _urls(rules), "op3_embedding_dedup": _near_vectors(), "op8_quality_rules": _quality()}
