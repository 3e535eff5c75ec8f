"""SQL of those training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str, nodes: str, node: str) -> str:
    """CTEs ``reach`` and ``comp``: the smallest node that links reach."""
    return f"""both_ AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
comp AS (SELECT {node} AS node, least({node}, coalesce((SELECT min(b) FROM reach WHERE a = {node}), {node})) AS component FROM {nodes})"""


OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
{_components("links", "s", "doc_id")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id FROM s JOIN comp ON doc_id = node"""

OP6 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_components("links", "v", "vec_id")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN comp ON vec_id = node"""

# Fixed patterns, written without case-insensitive groups, which would also fold letters beyond A to Z here.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 2, 12), ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16))
_CLASSES = (("hex", "[0-9A-Fa-f]{24,}", 24, 3.2), ("base64", "[A-Za-z0-9+/_=-]{24,}", 24, 4.0))
_ALLOWED = "^[a-z]+$|^[A-Z]+$|^[A-Z][a-z]+$|^[0-9]+$|^[A-Za-z]+([_/-][A-Za-z]+)+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def _found(name: str, pattern: str, group: int) -> str:
    """A CTE of doc_id, start, fin and value of every match, from the lengths of matches and of what is between them."""
    return f"""{name}_m AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS val FROM d),
{name} AS (SELECT doc_id, value, (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start,
  (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + list_sum(list_transform(whole[1:i], lambda g: length(g))))::BIGINT AS fin
  FROM (SELECT doc_id, gaps, whole, unnest(val) AS value, unnest(range(1, len(val) + 1)) AS i FROM {name}_m))"""


def _op8() -> str:
    ctes = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    ctes += [_found(f"k{k}", p, g) for k, (_, p, g, _) in enumerate(_KINDS)]
    base = " UNION ALL ".join(f"SELECT doc_id, start, {k} AS ord, '{n}' AS kind, fin FROM k{k} WHERE length(value) >= {least}" for k, (n, _, _, least) in enumerate(_KINDS))
    ctes.append(f"base AS ({base})")
    taken = "base"
    for k, (_, p, width, bits) in enumerate(_CLASSES):
        ctes.append(_found(f"e{k}", p, 0))
        ctes.append(f"""w{k} AS (SELECT doc_id, start, fin, i, unnest(string_split(substr(value, i + 1, {width}), '')) AS ch FROM (SELECT *, unnest(range(0, length(value) - {width} + 1)) AS i FROM e{k} WHERE NOT regexp_matches(value, '{_ALLOWED}'))),
h{k} AS (SELECT doc_id, start, i FROM (SELECT doc_id, start, i, ch, count(*) AS c FROM w{k} GROUP BY ALL) GROUP BY ALL HAVING log2({width}) - sum(c * log2(c)) / {width} >= {bits} - 1e-9),
s{k} AS (SELECT doc_id, start + min(i) AS start, {len(_KINDS)} AS ord, 'entropy' AS kind, start + max(i) + {width} AS fin FROM h{k} GROUP BY doc_id, h{k}.start),
t{k} AS (SELECT * FROM {taken} UNION ALL SELECT * FROM s{k} n WHERE NOT EXISTS (SELECT 1 FROM {taken} b WHERE b.doc_id = n.doc_id AND b.start <= n.start AND n.fin <= b.fin))""")
        taken = f"t{k}"
    counts = ", ".join(f"(SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND ord = {k}) AS n_{n}" for k, (n, *_) in enumerate(_KINDS))
    text = "coalesce((SELECT string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, ord) FROM {} b WHERE b.doc_id = d.doc_id), '')"
    return f"WITH {', '.join(ctes)} SELECT doc_id, {counts}, sha256({text.format('base')}) AS base_sha256, {text.format(taken)} AS spans FROM d"


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_H = ", ".join(f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u FROM documents),
c AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, {_H} FROM d),
e AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _op12(k: int = 40, rounds: int = 5, dimension: int = 64) -> str:
    """Every distance of every round, without bounds."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, cv FROM (SELECT sha256('2:' || vec_id) AS h, v AS cv FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(range(1, {dimension + 1}), lambda i: (v[i] - cv[i]) * (v[i] - cv[i])))::BIGINT, 'c': c}}) AS best FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, {dimension + 1})) AS i FROM a{r}) GROUP BY c, i)")
            ctes.append(f"m{r} AS (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS cv FROM s{r} GROUP BY c)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.cv, o.cv) AS cv FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return f"""WITH {', '.join(ctes)} SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = best.c"""


ORACLES = {"op5_jaccard_join": OP5, "op6_embedding_dedup": OP6, "op8_secret_scan": _op8(), "op11_fill_in_middle": OP11, "op12_centroid_clustering": _op12()}
