"""DuckDB SQL of the queries that SQL can express, by plain comparison of everything."""

from __future__ import annotations

from panelspark.llm import filter_audit, lm_score, merkle, minhash, quality

WORDS_OF = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

# Smallest id that each id reaches over links(a, b), both directions given.
REACH = """
    reach AS (SELECT id, id AS root FROM nodes
              UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.root),
    part AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)"""

NEAR_VECTORS = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
    nodes AS (SELECT id FROM n),
    links AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id
              WHERE list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm), {REACH},
    deg AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
    SELECT id AS vec_id, coalesce(deg.n, 0) AS n_links, root AS component_id, id = root AS kept
    FROM part LEFT JOIN deg ON deg.a = id"""

NEAR_DUPLICATES = f"""
    WITH RECURSIVE texts AS (
        SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1),
    w AS (SELECT id, {WORDS_OF} AS ws FROM texts),
    s AS (SELECT id, array_to_string(ws[i:i + {minhash.WORDS - 1}], ' ') AS s FROM (
        SELECT id, ws, unnest(range(1, greatest(2, len(ws) - {minhash.WORDS - 2}))) AS i
        FROM w WHERE len(ws) > 0)),
    c AS (SELECT id, s, count(*) AS n FROM s GROUP BY 1, 2),
    size AS (SELECT id, sum(n) AS n FROM c GROUP BY 1),
    shared AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS n
             FROM c x JOIN c y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN size p ON p.id = a JOIN size q ON q.id = b
              WHERE shared.n >= {minhash.THRESHOLD} * (p.n + q.n - shared.n) - 1e-9),
    nodes AS (SELECT id FROM texts), {REACH}
    SELECT doc_id, root AS class_id, copies, doc_id = root AS kept
    FROM documents JOIN texts USING (text) JOIN part USING (id)"""

_RULES = {"base": "base_failed", "symbols": "10 * n_symbols > word_chars",
          "lines": "5 * n_dup_lines > greatest(n_words, 1)",
          "word_length": "word_chars < 2 * greatest(n_words, 1)"
                         " OR word_chars > 15 * greatest(n_words, 1)"}


def _host_rates() -> str:
    counts = ", ".join(f"count(*) FILTER ({rule}) AS f_{n}" for n, rule in _RULES.items())
    prior = ", ".join(f"avg(f_{n} / docs) AS m_{n}, var_pop(f_{n} / docs) AS v_{n}"
                      for n in _RULES)
    strength = {n: f"(CASE WHEN v_{n} > 0 THEN least(1e6, greatest(1.0, "
                   f"m_{n} * (1 - m_{n}) / v_{n} - 1)) ELSE 1e6 END)" for n in _RULES}
    rates = ", ".join(f"(f_{n} + m_{n} * {strength[n]}) / (docs + {strength[n]})" for n in _RULES)
    return f"""
    hosts AS (SELECT source, count(*) AS docs, {counts} FROM rows GROUP BY 1),
    prior AS (SELECT {prior} FROM hosts),
    verdicts AS (SELECT source, greatest({rates}) <= {quality.MAX_RATE} AS host_kept
                 FROM hosts, prior)"""


QUALITY = f"""
    WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_OF} AS ws
               FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (
        SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n
              FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
        WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    m AS (SELECT doc_id, source, len(ws) AS n_words,
                 coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
          FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    rows AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
             FROM m), {_host_rates()}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND host_kept AS kept, source, host_kept
    FROM rows JOIN verdicts USING (source)"""

LM_SCORES = f"""
    WITH w AS (SELECT doc_id, {WORDS_OF} AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
    p AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM u),
    own1 AS (SELECT doc_id, word, count(*) AS n FROM u GROUP BY 1, 2),
    all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY 1),
    own2 AS (SELECT doc_id, prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL
             GROUP BY 1, 2, 3),
    all2 AS (SELECT prev, word, sum(n) AS n FROM own2 GROUP BY 1, 2),
    c1 AS (SELECT doc_id, word, all1.n - own1.n AS n FROM own1 JOIN all1 USING (word)),
    c2 AS (SELECT doc_id, prev, word, all2.n - own2.n AS n
           FROM own2 JOIN all2 USING (prev, word)),
    rest AS (SELECT doc_id, (SELECT count(*) FROM u) - len(ws) AS n FROM w),
    s AS (SELECT p.doc_id, CASE WHEN c2.n > 0 THEN ln(c2.n / c.n)
                 ELSE CASE WHEN p.prev IS NULL THEN 0 ELSE ln({lm_score.BACKOFF}) END
                      + CASE WHEN c1.n > 0 THEN ln(c1.n / rest.n) ELSE -ln(rest.n + 1) END
                 END AS s
          FROM p JOIN rest USING (doc_id) JOIN c1 USING (doc_id, word)
          LEFT JOIN c1 c ON c.doc_id = p.doc_id AND c.word = p.prev
          LEFT JOIN c2 ON c2.doc_id = p.doc_id AND c2.prev = p.prev AND c2.word = p.word)
    SELECT doc_id, len(ws) AS n_words, round(m, 6) AS log_score, round(exp(-m), 6) AS perplexity
    FROM w LEFT JOIN (SELECT doc_id, avg(s) AS m FROM s GROUP BY 1) USING (doc_id)"""


# CRC 32 of a short ASCII text: bytes folded one by one, eight shifts each.
CRC32 = """(xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda a, b: xor(a >> 1, 3988292384 * (a & 1))))))"""


def _merkle(levels: int = 10) -> str:
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f for f in merkle.FIELDS]
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR, '-')"
            for f in fields) + ")"

    def climb(start: str, key: str, name: str) -> str:
        """Levels {name}0.. of the nodes of `start`(tree, place, h), with siblings {name}s0.. ."""
        out = [f"{name}0 AS (SELECT tree, place, h, count(*) OVER (PARTITION BY tree) AS c"
               f" FROM {start})"]
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM (
                SELECT tree, place // 8 AS place, CASE WHEN any_value(c) = 1 THEN any_value(h)
                       ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
                FROM {name}{k} GROUP BY tree, place // 8))""")
            out.append(f"""{name}s{k} AS (SELECT a.tree, a.place, any_value(a.c) AS c,
                coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS u,
                coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS v
                FROM {name}{k} a LEFT JOIN {name}{k} b ON a.tree = b.tree AND a.place <> b.place
                     AND a.place // 8 = b.place // 8 GROUP BY a.tree, a.place)""")
        return ", ".join(out)

    def walk(start: str, name: str, to: str) -> str:
        """Fold x and gather the proof of the rows of `start` along the levels of `name`."""
        out, last = [], start
        for k in range(levels):
            out.append(f"""{to}{k} AS (SELECT r.* REPLACE (
                CASE WHEN c > 1 THEN sha256(u || x || v) ELSE x END AS x,
                proof || u || v AS proof) FROM {last} r
                JOIN {name}s{k} s ON s.tree = r.tree AND s.place = r.place // {8 ** k})""")
            last = f"{to}{k}"
        return ", ".join(out)

    lowered = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    return f"""
    WITH l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf,
                      CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0
                           THEN {leaf(lowered)} ELSE {leaf('text')} END AS x FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1
                    AS place FROM l),
    start AS (SELECT tree, place, leaf AS h FROM p), {climb('start', 'tree', 'n')},
    tops AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS place
             FROM n{levels}), {climb('tops', 'name', 't')},
    r0 AS (SELECT doc_id, leaf, tree, place, x, '' AS proof FROM p), {walk('r0', 'n', 'w')},
    r1 AS (SELECT doc_id, leaf, tops.h AS subroot, '' AS tree, tops.place AS place, x, proof
           FROM w{levels - 1} w JOIN tops ON tops.name = w.tree), {walk('r1', 't', 'z')}
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, x AS folded_root,
           x = t.h AS verified
    FROM z{levels - 1}, t{levels} t"""


MERKLE = _merkle()

AUDIT = f"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      {WORDS_OF} AS ws FROM documents),
    first AS (SELECT text, min(doc_id) AS id FROM w GROUP BY 1),
    flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
              FROM labels GROUP BY 1),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 len(ws) < {filter_audit.MIN_WORDS} AS a,
                 100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT} * len(ws) AS b,
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g'))
                     > {filter_audit.MAX_UPPER} * length(text) AS c,
                 regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first.id, false) AS e
          FROM w JOIN first USING (text) LEFT JOIN flags USING (doc_id)),
    k AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n
          FROM m GROUP BY ALL),
    f AS (SELECT unnest(range(1, 6)) AS i),
    orders AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM f p, f q, f r, f s, f t
               WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
    steps AS (SELECT o, list_reduce(list_transform(o, lambda x: substr('ABCDE', x, 1)),
                                    lambda x, y: x || y) AS filter_order,
                     unnest(range(1, 6)) AS step FROM orders),
    x AS (SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, fails[o[step]] AS failing,
                 list_contains(list_transform(o[:step - 1], lambda i: fails[i]), true) AS gone,
                 len(list_filter(fails, lambda i: i)) = 1 AS single
          FROM steps, k),
    y AS (SELECT part, filter_order, step, filter,
                 coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (failing AND single), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
                 coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
          FROM x GROUP BY ALL)
    SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
    FROM y"""

ORACLE_SQL = {"op12_merkle_manifest": MERKLE, "op13_filter_audit": AUDIT,
              "op3_near_vectors": NEAR_VECTORS, "op6_near_duplicates": NEAR_DUPLICATES,
              "op7_quality": QUALITY, "op9_lm_scores": LM_SCORES}
