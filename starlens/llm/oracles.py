"""SQL of the operators whose statement is built from repeated steps."""

from __future__ import annotations

from starlens.llm import vector_codes

#: Levels that the statement climbs: 8 ** 6 rows per language, 8 ** 3 languages.
_LEVELS, _TOP_LEVELS = 6, 3


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


# One step per bit of each decimal digit of the id.
_CRC = (
    "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
    "lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"
)


def _climb(name: str, rows: str, levels: int) -> list[str]:
    """Tables {name}_up0, ... of nodes (tree, pos, n, h) and {rows}_{name}0, ... of rows (id, tree, pos, cur, proof)."""
    out = []
    for k in range(levels):
        up, own = f"{name}_up{k}", f"{rows}_{name}{k}"
        out.append(f"""{name}_up{k + 1} AS MATERIALIZED (
            SELECT tree, pos // 8 AS pos, CAST(ceil(any_value(n) / 8) AS BIGINT) AS n,
                   CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
            FROM {up} GROUP BY tree, pos // 8)""")
        out.append(f"""{rows}_{name}{k + 1} AS MATERIALIZED (
            SELECT id, any_value(tree) AS tree, any_value(pos) // 8 AS pos,
                   CASE WHEN any_value(n) > 1 THEN sha256(any_value(l) || any_value(cur) || any_value(r)) ELSE any_value(cur) END AS cur,
                   CASE WHEN any_value(n) > 1 THEN any_value(proof) || any_value(l) || any_value(r) ELSE any_value(proof) END AS proof
            FROM (SELECT d.id, d.tree, d.pos, d.cur, d.proof, any_value(u.n) AS n,
                         coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < d.pos), '') AS l,
                         coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > d.pos), '') AS r
                  FROM {own} d JOIN {up} u ON u.tree = d.tree AND u.pos // 8 = d.pos // 8
                  GROUP BY d.id, d.tree, d.pos, d.cur, d.proof)
            GROUP BY id)""")
    return out


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = ", ".join(
    [
        f"""WITH leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS id, doc_id, coalesce('l' || lang, '') AS tree, {_leaf('text')} AS h,
                   CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS other
            FROM documents)""",
        """placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n FROM leaves)""",
        "own_up0 AS MATERIALIZED (SELECT tree, pos, n, h FROM placed)",
        "doc_own0 AS MATERIALIZED (SELECT id, tree, pos, other AS cur, '' AS proof FROM placed)",
        *_climb("own", "doc", _LEVELS),
        f"""subroots AS MATERIALIZED (
            SELECT tree AS own, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM own_up{_LEVELS})""",
        "top_up0 AS MATERIALIZED (SELECT 't' AS tree, pos, n, h FROM subroots)",
        f"""doc_top0 AS MATERIALIZED (
            SELECT id, 't' AS tree, s.pos, cur, proof FROM doc_own{_LEVELS} d JOIN subroots s ON s.own = d.tree)""",
        *_climb("top", "doc", _TOP_LEVELS),
    ]
) + f"""
    SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(d.proof) AS proof_sha256,
           d.cur AS folded_root, d.cur = t.h AS verified
    FROM placed p JOIN subroots s ON s.own = p.tree JOIN doc_top{_TOP_LEVELS} d ON d.id = p.id JOIN top_up{_TOP_LEVELS} t ON true
"""


def _nearest(books: str) -> str:
    """(vec_id, part, entry, apart) of each part's nearest entry."""
    return f"""SELECT vec_id, part, arg_min(entry, apart * 1024 + entry) AS entry, min(apart) AS apart FROM (
        SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS apart
        FROM components c JOIN {books} b ON b.part = c.part AND b.i = c.i GROUP BY c.vec_id, c.part, b.entry)
        GROUP BY vec_id, part"""


def _round(k: int) -> list[str]:
    return [
        f"near{k} AS MATERIALIZED ({_nearest(f'books{k}')})",
        f"""books{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, b.i, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN (
                SELECT part, entry, i, CAST((total - ((total % n) + n) % n) / n AS BIGINT) AS x FROM (
                    SELECT c.part, a.entry, c.i, sum(c.x) AS total, count(*) AS n
                    FROM components c JOIN near{k} a ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY c.part, a.entry, c.i)
            ) m ON m.part = b.part AND m.entry = b.entry AND m.i = b.i)""",
    ]


VECTOR_CODES = ", ".join(
    [
        f"""WITH kept AS MATERIALIZED (
            SELECT vec_id, label, embedding, len(embedding) // {vector_codes.PARTS} AS width FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""components AS MATERIALIZED (
            SELECT vec_id, (place - 1) // width AS part, (place - 1) % width AS i, CAST(floor({vector_codes.SCALE} * x) AS BIGINT) AS x
            FROM (SELECT vec_id, width, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM kept))""",
        f"""books0 AS MATERIALIZED (
            SELECT c.part, f.entry, c.i, c.x FROM components c JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) f ON f.vec_id = c.vec_id
            WHERE f.entry < {vector_codes.ENTRIES})""",
        *[step for k in range(vector_codes.ROUNDS) for step in _round(k)],
        f"last AS MATERIALIZED ({_nearest(f'books{vector_codes.ROUNDS}')})",
        """coded AS MATERIALIZED (
            SELECT k.vec_id, any_value(k.label) AS label, string_agg(printf('%02x', CAST(a.entry AS INTEGER)), '' ORDER BY a.part) AS code,
                   CAST(sum(a.apart) AS BIGINT) AS error
            FROM kept k JOIN last a ON a.vec_id = k.vec_id GROUP BY k.vec_id)""",
    ]
) + f"""
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM books{vector_codes.ROUNDS}) AS codebooks_sha256
    FROM coded
"""
