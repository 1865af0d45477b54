"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from textcurate.llm import licenses


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, c))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, c: {bits}, 4294967295::BIGINT), 4294967295)"


def _levels(name: str, levels: int) -> str:
    """From ``name0 (tree, i, d)``: the nodes of each level, and their siblings to the left and right."""
    parts = []
    for k in range(levels):
        parts.append(f"""
            {name}{k}_of AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS more FROM {name}{k}),
            {name}{k}_side AS MATERIALIZED (
                SELECT a.tree, a.i, any_value(a.more) AS more,
                    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                FROM {name}{k}_of a JOIN {name}{k}_of b ON a.tree = b.tree AND a.i // 8 = b.i // 8 GROUP BY ALL
            ),
            {name}{k + 1} AS MATERIALIZED (
                SELECT tree, i // 8 AS i, CASE WHEN any_value(more) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d
                FROM {name}{k}_of GROUP BY tree, i // 8
            )""")
    return ",".join(parts)


def _climb(name: str, levels: int, start: str, tree: str, place: str) -> str:
    """From ``start (*, h, p)``: the digest that folding makes of ``h``, and the siblings met behind ``p``."""
    parts, before = [], start
    for k in range(levels):
        after = f"{name}{k}_up"
        parts.append(f"""
            {after} AS (
                SELECT x.* REPLACE (CASE WHEN s.more THEN sha256(s.l || x.h || s.r) ELSE x.h END AS h,
                    CASE WHEN s.more THEN x.p || s.l || s.r ELSE x.p END AS p)
                FROM {before} x JOIN {name}{k}_side s ON s.tree = {tree} AND s.i = x.{place} // {8**k}
            )""")
        before = after
    return ",".join(parts)


def merkle(levels: int = 8, top_levels: int = 3) -> str:
    """For up to ``8 ** levels`` rows in a language and ``8 ** top_levels`` languages."""

    def digest(text: str) -> str:
        values = ["doc_id", "source", "lang", "n_chars", text]
        return f"""sha256({" || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values)})"""

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH leaves AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {digest("text")} AS leaf,
                CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {digest(f"translate(text, '{upper}', '{upper.lower()}')")}
                ELSE leaf END AS h
            FROM documents
        ), ranked AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
        ), l0 AS (SELECT tree, place AS i, leaf AS d FROM ranked), {_levels("l", levels)},
        sub AS MATERIALIZED (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS top_place FROM l{levels}),
        t0 AS (SELECT 0 AS tree, top_place AS i, d FROM sub), {_levels("t", top_levels)},
        start AS (SELECT doc_id, leaf, tree, place, h, '' AS p FROM ranked), {_climb("l", levels, "start", "x.tree", "place")},
        middle AS (SELECT u.*, sub.d AS subroot, sub.top_place FROM l{levels - 1}_up u JOIN sub USING (tree)),
        {_climb("t", top_levels, "middle", "0", "top_place")}
        SELECT doc_id, leaf, subroot, t{top_levels}.d AS root, sha256(p) AS proof_sha256, h AS folded_root,
            h = t{top_levels}.d AS verified
        FROM t{top_levels - 1}_up, t{top_levels}
    """


def license_scan() -> str:
    """Every block against every template, without any filter."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    known = [licenses.Template.of(label, text, licenses.THRESHOLD) for label, text in licenses.TEMPLATES]

    def listed(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    templates = ", ".join(f"('{t.label}', {listed(sorted(t.words))}, {t.need}, {t.block})" for t in known)
    places = []
    for label, phrase in licenses.PHRASES:
        parts = phrase.split()
        stands = " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        starts = f"list_filter(range(len(words)), lambda i: {stands})"
        places.append(f"list_transform({starts}, lambda i: struct_pack(label := '{label}', at := i))")
    return f"""
        WITH texts AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}') AS words
            FROM documents
        ), base AS (
            SELECT row, len(places) AS n_base, list_min(list_transform(places, lambda p: p.at)) AS first_word,
                list_max(list_transform(places, lambda p: p.at)) AS last_word,
                list_distinct(list_transform(places, lambda p: p.label)) AS base_labels
            FROM (SELECT row, {" || ".join(places)} AS places FROM texts)
        ), templates(label, tokens, need, block) AS (VALUES {templates}),
        widths AS (SELECT DISTINCT block FROM templates),
        blocks AS (
            SELECT row, block, list_distinct(words[k * block + 1 : k * block + 2 * block]) AS tokens
            FROM texts, widths, unnest(range((len(words) + block - 1) // block)) AS u(k)
        ), shared AS (
            SELECT row, label, len(list_intersect(b.tokens, t.tokens)) AS n, need, len(t.tokens) AS size
            FROM blocks b JOIN templates t USING (block)
        ), found AS (
            SELECT row, list(DISTINCT label) AS added, max(n / size) AS score FROM shared WHERE n >= need GROUP BY row
        )
        SELECT doc_id, len(words) AS n_words, n_base, first_word, last_word,
            array_to_string(list_sort(base_labels), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(base_labels || coalesce(added, []))), ',') AS labels,
            coalesce(score, 0.0)::DOUBLE AS score
        FROM texts JOIN base USING (row) LEFT JOIN found USING (row)
    """
