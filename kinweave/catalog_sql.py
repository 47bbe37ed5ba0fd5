"""DuckDB SQL with the rows of the queries in ``catalog``, written from the rules and independent of the operators."""

from __future__ import annotations

from kinweave.plans import derived
from kinweave.sources import reference as ref


def _text(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


def _pick(values) -> str:
    return "[" + ", ".join(map(_text, values)) + f"][(k % {len(values)})::INT + 1]"


def _tables() -> dict[str, str]:
    columns = ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in derived.EXPRESSIONS.items())
    gaz = [(i, n, a, b, c, m) for i, (names, a, b, c, m) in enumerate(ref.GAZETTEER) for n in names]
    pol = [(y, i, n, *ref.POLITIES[n]) for y, names in ref.SNAPSHOTS.items() for i, n in enumerate(names)]
    canon = [(a, c) for c, names in ref.CANONICAL.items() for a in names]
    case = " ".join(
        f"WHEN regexp_matches(place, '(?i)\\b({words})\\b') THEN CASE WHEN NOT (lng BETWEEN {w - ref.ANCIENT_MARGIN} AND {e + ref.ANCIENT_MARGIN} AND lat BETWEEN {s - ref.ANCIENT_MARGIN} AND {n + ref.ANCIENT_MARGIN}) THEN {_text(name)} END"
        for name, words, w, s, e, n in ref.ANCIENT
    )
    number = lambda x: f"regexp_replace({x}::VARCHAR, '\\.0$', '')"
    border = lambda x: f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z ]', '', 'g'))"
    country = lambda x: f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
    return {
        "ppl": f"SELECT *, k AS id, {_pick(derived.PLACES)} AS place, {columns} FROM (SELECT c_custkey AS k FROM customer) c, (SELECT count(*) AS n FROM customer) t",
        "edge": "SELECT id AS child_id, 'F' AS slot, father AS parent_id FROM ppl WHERE father IS NOT NULL UNION ALL SELECT id, 'M', mother FROM ppl WHERE mother IS NOT NULL",
        "visit": "SELECT 0::BIGINT AS id, 0 AS depth, 1.0::DOUBLE AS w, [0::BIGINT] AS path, '' AS path_key UNION ALL SELECT e.parent_id, v.depth + 1, v.w / 2, list_append(v.path, e.parent_id), v.path_key || e.slot FROM visit v JOIN edge e ON e.child_id = v.id WHERE v.depth < 8 AND NOT list_contains(v.path, e.parent_id)",
        "step": "SELECT v.*, p.father, p.mother, (p.father IS NULL AND p.mother IS NULL) OR v.depth >= 8 AS ends FROM visit v JOIN ppl p USING (id)",
        "node": "SELECT id, count(*) AS times_reached, sum(w) AS contribution_weight, sum(CASE WHEN ends THEN w ELSE 0 END) AS leaf_weight, bool_or(ends) AS is_leaf, min(path_key) AS path_key, min(depth) AS min_depth FROM step GROUP BY id",
        "slots": "SELECT id, depth, w, path, path_key || 'F' AS path_key, 'father' AS slot, father AS parent_id FROM step WHERE NOT ends UNION ALL SELECT id, depth, w, path, path_key || 'M', 'mother', mother FROM step WHERE NOT ends",
        "gap": "SELECT id AS missing_parent_of, slot, (arg_min(depth, path_key) + 1)::INT AS depth, sum(w) / 2 AS contribution_weight FROM slots WHERE parent_id IS NULL OR list_contains(path, parent_id) GROUP BY id, slot",
        "link": "SELECT DISTINCT id AS child_id, parent_id FROM slots WHERE parent_id IS NOT NULL",
        "gaz": f"SELECT ord, name, glat::DOUBLE AS glat, glng::DOUBLE AS glng, code, gcountry FROM {_values(gaz)} t(ord, name, glat, glng, code, gcountry)",
        "toks": "SELECT id, place, trim(u.t) AS t, u.pos FROM (SELECT id, place, unnest(string_split(place, ',')) AS t, generate_subscripts(string_split(place, ','), 1) AS pos FROM ppl) u WHERE trim(u.t) <> ''",
        "geo": "SELECT t.id, arg_min({'token': g.name, 'glat': g.glat, 'glng': g.glng, 'code': g.code, 'gcountry': g.gcountry}, t.pos) AS h FROM (SELECT id, pos, strip_accents(lower(t)) AS key FROM toks) t JOIN (SELECT strip_accents(name) AS name, arg_max(glat, ord) AS glat, arg_max(glng, ord) AS glng, arg_max(code, ord) AS code, arg_max(gcountry, ord) AS gcountry FROM gaz GROUP BY 1) g ON g.name = t.key GROUP BY t.id",
        "canon": f"SELECT * FROM {_values(canon)} t(alias, canonical)",
        "raw": "SELECT p.id, p.place, p.year, p.lat, p.lng, CASE WHEN p.lat IS NULL THEN g.h.gcountry ELSE (SELECT arg_max(t, pos) FROM toks k WHERE k.id = p.id) END AS country_raw, CASE WHEN p.lat IS NULL THEN g.h END AS h FROM ppl p LEFT JOIN geo g ON g.id = p.id",
        "named": f"SELECT r.*, CASE WHEN country_raw IS NULL THEN NULL ELSE coalesce(c.canonical, CASE WHEN regexp_matches({country('country_raw')}, '{ref.US_SUFFIX}') THEN 'United States' END, country_raw) END AS country FROM raw r LEFT JOIN canon c ON c.alias = {country('r.country_raw')}",
        "box": f"SELECT ord, name, {border('name')} AS key, w, s, e, n FROM {_values([(i, *b) for i, b in enumerate(ref.COARSE_BORDERS)])} t(ord, name, w, s, e, n)",
        "modern": f"SELECT * FROM {_values(ref.MODERN.items())} t(alias, key)",
        "bkey": "SELECT alias, key FROM modern UNION ALL SELECT DISTINCT key, key FROM box WHERE key NOT IN (SELECT alias FROM modern)",
        "ptc": "SELECT p.id, arg_min(b.name, b.ord) AS point_country FROM ppl p LEFT JOIN box b ON p.lng BETWEEN b.w AND b.e AND p.lat BETWEEN b.s AND b.n WHERE p.lat IS NOT NULL GROUP BY p.id",
        "contra": f"SELECT n.id, n.country, CASE WHEN k1.key IS NOT NULL THEN t.point_country END AS point_country, k1.key IS NOT NULL AS string_known, coalesce(k1.key <> k2.key AND NOT (k1.key IN ('united kingdom', 'ireland') AND k2.key IN ('united kingdom', 'ireland')), false) AS contradicts FROM named n JOIN ptc t USING (id) LEFT JOIN bkey k1 ON k1.alias = {border('n.country')} LEFT JOIN bkey k2 ON k2.alias = {border('t.point_country')}",
        "anc": f"SELECT id, CASE {case} END AS ancient FROM ppl WHERE lat IS NOT NULL",
        "pol": f"SELECT * FROM {_values(pol)} t(snapshot_year, ord, name, part_of, prec, w, s, e, n)",
        "snap": "SELECT id, coalesce((SELECT max(snapshot_year) FROM pol WHERE snapshot_year <= p.year), (SELECT min(snapshot_year) FROM pol)) AS snapshot_year FROM ppl p WHERE year IS NOT NULL",
        "pre": "SELECT n.*, coalesce(c.contradicts, false) AS contradicts, c.point_country, CASE WHEN NOT c.string_known THEN a.ancient END AS ancient, coalesce(n.lat, n.h.glat) AS at_lat, coalesce(n.lng, n.h.glng) AS at_lng FROM named n LEFT JOIN contra c USING (id) LEFT JOIN anc a USING (id)",
        "acc": "SELECT *, contradicts OR ancient IS NOT NULL AS bad FROM pre",
        "intime": "SELECT a.id, arg_min({'snapshot_year': p.snapshot_year, 'name': p.name, 'part_of': p.part_of, 'prec': p.prec}, p.ord) AS pol FROM acc a JOIN snap s USING (id) JOIN pol p ON p.snapshot_year = s.snapshot_year AND a.at_lng BETWEEN p.w AND p.e AND a.at_lat BETWEEN p.s AND p.n WHERE NOT a.bad GROUP BY a.id",
        "res": f"""SELECT a.id, CASE WHEN NOT bad THEN at_lat END AS coord_lat, CASE WHEN NOT bad THEN at_lng END AS coord_lng, country AS modern_country, country_raw AS modern_country_raw,
            CASE WHEN pol IS NULL THEN country ELSE pol.name END AS historical_polity, pol.part_of AS cultural_region,
            CASE WHEN bad THEN 0.4::DOUBLE WHEN at_lat IS NULL THEN 0.0::DOUBLE ELSE CASE WHEN lat IS NULL THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END * CASE WHEN pol IS NULL THEN 1.0::DOUBLE ELSE pol.prec::DOUBLE / 3.0::DOUBLE END END AS confidence,
            pol.prec::INT AS border_precision,
            CASE WHEN at_lat IS NULL THEN CASE WHEN coalesce(trim(place), '') = '' THEN 'empty' ELSE 'geonames:no-match' END
                 WHEN bad THEN 'gedcom-embedded-coords:(' || {number('lat')} || ',' || {number('lng')} || '); ' || CASE WHEN contradicts THEN 'coord-rejected:string="' || country || '",point-in="' || point_country || '"' ELSE 'coord-rejected:ancient="' || ancient || '",point=(' || printf('%.2f', lat) || ',' || printf('%.2f', lng) || ')' END || CASE WHEN country <> country_raw THEN '; canon:"' || country_raw || '"->"' || country || '"' ELSE '' END
                 ELSE CASE WHEN lat IS NULL THEN 'geonames:"' || h.token || '"->(' || {number('h.glat')} || ',' || {number('h.glng')} || ') ' || h.code ELSE 'gedcom-embedded-coords:(' || {number('lat')} || ',' || {number('lng')} || ')' END
                      || CASE WHEN country <> country_raw THEN '; canon:"' || country_raw || '"->"' || country || '"' ELSE '' END
                      || CASE WHEN year IS NULL THEN '; no-date(historical=modern)' WHEN pol IS NULL THEN '; histbasemaps:no-polygon@' || year || '(fallback->modern)' ELSE '; histbasemaps:' || pol.snapshot_year || ' "' || pol.name || '" partOf=' || pol.part_of || ' prec=' || pol.prec END END AS provenance
            FROM acc a LEFT JOIN intime i USING (id)""",
        "rnode": "SELECT n.*, r.* EXCLUDE (id), p.place, p.year FROM node n JOIN res r USING (id) JOIN ppl p USING (id)",
        "cov": "SELECT sum(CASE WHEN is_leaf AND modern_country IS NOT NULL THEN leaf_weight ELSE 0 END) AS resolved_weight, sum(CASE WHEN is_leaf AND modern_country IS NULL THEN leaf_weight ELSE 0 END) AS unresolved_weight, (SELECT coalesce(sum(contribution_weight), 0) FROM gap) AS gap_weight FROM rnode",
        "reg": " UNION ALL ".join(f"SELECT '{g}' AS granularity, {c} AS region, is_leaf, leaf_weight, path_key FROM rnode WHERE modern_country IS NOT NULL AND {c} <> ''" for g, c in (("modernCountry", "modern_country"), ("historicalPolity", "historical_polity"), ("culturalRegion", "cultural_region"))),
        "frac": "SELECT granularity, region, sum(leaf_weight) AS value, row_number() OVER (PARTITION BY granularity ORDER BY sum(leaf_weight) DESC, min(path_key)) AS rank FROM reg WHERE is_leaf GROUP BY granularity, region",
        "vars": "SELECT modern_country AS region, list_sort(list_distinct(list(modern_country_raw))) AS variants FROM rnode WHERE modern_country_raw <> modern_country GROUP BY 1",
        "seen": "SELECT *, coord_lat AS lat0, coord_lng AS lng0, row_number() OVER (PARTITION BY floor(coord_lat / 0.05 + 0.5), floor(coord_lng / 0.05 + 0.5) ORDER BY contribution_weight DESC, path_key) - 1 AS rk FROM rnode WHERE coord_lat IS NOT NULL",
        "spread": "SELECT * EXCLUDE (lat0, lng0, rk), CASE WHEN rk > 0 THEN lat0 + 0.16 * sqrt(rk) * sin(rk * 2.399963229728653) ELSE lat0 END AS lat, CASE WHEN rk > 0 THEN lng0 + 0.16 * sqrt(rk) * cos(rk * 2.399963229728653) / greatest(0.2, cos(radians(lat0))) ELSE lng0 END AS lng FROM seen",
        "arcs": "SELECT * FROM (SELECT l.child_id, l.parent_id, p.contribution_weight AS weight, p.min_depth AS depth, p.modern_country AS region, 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - c.lng) / 2), 2)))) AS km FROM link l JOIN spread c ON c.id = l.child_id JOIN spread p ON p.id = l.parent_id) WHERE weight >= 0.002 OR (km >= 1500 AND weight >= 0.0001)",
        "clos": "SELECT child_id AS id, parent_id AS ancestor_id FROM edge UNION SELECT c.id, e.parent_id FROM clos c JOIN edge e ON e.child_id = c.ancestor_id",
        "allv": "SELECT id AS root_id, id, 0 AS depth, 1.0::DOUBLE AS w FROM ppl UNION ALL SELECT v.root_id, e.parent_id, v.depth + 1, v.w / 2 FROM allv v JOIN edge e ON e.child_id = v.id WHERE v.depth < 8",
        "alls": "SELECT v.*, p.father, p.mother, (p.father IS NULL AND p.mother IS NULL) OR v.depth >= 8 AS ends FROM allv v JOIN ppl p USING (id)",
    }


def _with(*names: str, body: str, **changed: str) -> str:
    tables = _tables() | changed
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({tables[n]})" for n in names) + "\n" + body


WALK = ("ppl", "edge", "visit", "step", "node", "slots", "gap", "link")
RESOLVE = ("gaz", "toks", "geo", "canon", "raw", "named", "box", "modern", "bkey", "ptc", "contra", "anc", "pol", "snap", "pre", "acc", "intime", "res")
NODES = (*WALK, *RESOLVE, "rnode")


def _raw(values) -> str:
    return f"SELECT c_custkey AS id, {_pick(values).replace('k %', 'c_custkey %')} AS raw FROM customer"


def _shapes() -> str:
    """The shapes of the test by inequalities: sides of a triangle; a box without the inside of another; two boxes."""
    (x1, y1), (x2, y2), (x3, y3), _ = derived.SHAPES[0][1][0][0]
    left = lambda a, b, c, d: f"({c} - {a}) * (lat - {b}) - ({d} - {b}) * (lng - {a}) >= 0"
    box = lambda ring: f"lng BETWEEN {ring[0][0]} AND {ring[2][0]} AND lat BETWEEN {ring[0][1]} AND {ring[2][1]}"
    outer, hole = derived.SHAPES[1][1][0]
    open_ = f"lng > {hole[0][0]} AND lng < {hole[2][0]} AND lat > {hole[0][1]} AND lat < {hole[2][1]}"
    parts = " OR ".join(f"({box(p[0])})" for p in derived.SHAPES[2][1])
    return f"WHEN {left(x1, y1, x2, y2)} AND {left(x2, y2, x3, y3)} AND {left(x3, y3, x1, y1)} THEN 'Slanted' WHEN {box(outer)} AND NOT ({open_}) THEN 'Holed' WHEN {parts} THEN 'Parted'"


def oracle_sql() -> dict[str, str]:
    cyclic = _tables()["ppl"].replace("SELECT *, k AS id", "SELECT * REPLACE (CASE WHEN id = 1 THEN 0 ELSE father END AS father) FROM (SELECT *, k AS id") + ")"
    looped = _tables()["ppl"].replace("SELECT *, k AS id", "SELECT * REPLACE (CASE WHEN id % 256 = 7 THEN id // 4 ELSE father END AS father) FROM (SELECT *, k AS id") + ")"
    guarded = "SELECT id AS root_id, id, 0 AS depth, 1.0::DOUBLE AS w, [id] AS path FROM ppl UNION ALL SELECT v.root_id, e.parent_id, v.depth + 1, v.w / 2, list_append(v.path, e.parent_id) FROM allv v JOIN edge e ON e.child_id = v.id WHERE v.depth < 8 AND NOT list_contains(v.path, e.parent_id)"
    lost = " + ".join(f"CASE WHEN NOT ends AND ({p} IS NULL OR list_contains(path, {p})) THEN w / 2 ELSE 0 END" for p in ("father", "mother"))
    top = "(k * 7919 % 997)::DOUBLE / 997 * 30 + k % 3 * 25 - 40"
    corner = f"SELECT (k % 3)::INT AS ord, k // 3 AS j, (k // 3)::DOUBLE / (n // 3 + 1) * 350 - 175 AS x, {top} AS y FROM ppl"
    coast = "SELECT ord, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM (SELECT ord, j, x, y FROM corner UNION ALL SELECT DISTINCT ord, -1, -175::DOUBLE, -85::DOUBLE FROM corner UNION ALL SELECT DISTINCT ord, 1000000000, 175::DOUBLE, -85::DOUBLE FROM corner UNION ALL SELECT DISTINCT ord, 1000000001, -175::DOUBLE, -85::DOUBLE FROM corner) WINDOW o AS (PARTITION BY ord ORDER BY j)"
    stub = _values((k, v, ref.CULTURE.get(v)) for k, v in ref.STUB.items())
    coords = r"^([NSEWnsew])?\s*(-?[0-9]+(?:\.[0-9]+)?)$"
    side, number = f"upper(regexp_extract(raw, '{coords}', 1))", f"TRY_CAST(regexp_extract(raw, '{coords}', 2) AS DOUBLE)"
    slashed = "regexp_matches(raw, '^(.*?)/(.*?)/')"
    part = lambda n: f"nullif(trim(regexp_extract(raw, '^(.*?)/(.*?)/', {n})), '')"
    some = "father IS NOT NULL OR mother IS NOT NULL"
    return {
        "parent_edges": _with("ppl", "edge", body="SELECT * FROM edge"),
        "pedigree_nodes": _with(*WALK, body="SELECT n.id, times_reached, contribution_weight, leaf_weight, is_leaf, d.depths FROM node n JOIN (SELECT id, string_agg(depth::VARCHAR, ',' ORDER BY pk) AS depths FROM (SELECT id, depth, min(path_key) AS pk FROM visit GROUP BY ALL) GROUP BY id) d USING (id)"),
        "person_lookup": _with(*WALK, body="SELECT id, times_reached, contribution_weight, is_leaf FROM node WHERE id = 11"),
        "pedigree_gaps": _with(*WALK, body="SELECT 'gap:' || missing_parent_of || ':' || slot AS id, * FROM gap"),
        "pedigree_cycle": _with(*WALK, body="SELECT * FROM gap", ppl=cyclic),
        "pedigree_links": _with(*WALK, body="SELECT * FROM link"),
        "pedigree_counts": _with(*WALK, body="SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, (SELECT count(*) FROM gap) AS gaps, count(*) FILTER (times_reached > 1) AS collapsed FROM node"),
        "coverage_budget": _with(*NODES, "cov", body="SELECT * FROM cov"),
        "coverage_all_roots": _with("ppl", "edge", "allv", "alls", body="SELECT root_id, count(DISTINCT id) AS persons, sum(CASE WHEN ends THEN w ELSE 0 END) AS leaf_weight, sum(CASE WHEN NOT ends AND father IS NULL THEN w / 2 ELSE 0 END + CASE WHEN NOT ends AND mother IS NULL THEN w / 2 ELSE 0 END) AS gap_weight FROM alls GROUP BY root_id"),
        "coverage_looped_roots": _with("ppl", "edge", "allv", "alls", body=f"SELECT root_id, count(DISTINCT id) AS persons, count(*) AS visits, sum(CASE WHEN ends THEN w ELSE 0 END) AS leaf_weight, sum({lost}) AS gap_weight FROM alls GROUP BY root_id", ppl=looped, allv=guarded),
        "looped_closure_counts": _with("ppl", "edge", "clos", body="SELECT p.id, count(c.ancestor_id) AS ancestors FROM ppl p LEFT JOIN clos c USING (id) GROUP BY p.id", ppl=looped),
        "snapshot_asof_many": "WITH s AS (SELECT DISTINCT (c_custkey * 104729 % 1000003)::INT AS snapshot FROM customer WHERE c_custkey % 5 = 2), d AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1000003 - 5)::INT AS day FROM customer) SELECT id, day, coalesce(s.snapshot, (SELECT min(snapshot) FROM s)) AS snapshot FROM d ASOF LEFT JOIN s ON d.day >= s.snapshot",
        "country_in_coasts": _with("ppl", "corner", "side", "held", body="SELECT p.id, 'Coast ' || min(h.ord) AS point_country FROM ppl p LEFT JOIN held h ON h.id = p.id WHERE p.lat IS NOT NULL GROUP BY p.id", corner=corner, side=coast, held="SELECT p.id, s.ord FROM ppl p JOIN side s ON (s.y1 > p.lat) <> (s.y2 > p.lat) AND p.lng < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1 WHERE p.lat IS NOT NULL GROUP BY p.id, s.ord HAVING count(*) % 2 = 1"),
        "ancestor_closure_counts": _with("ppl", "edge", "clos", body="SELECT p.id, count(c.ancestor_id) AS ancestors FROM ppl p LEFT JOIN clos c USING (id) GROUP BY p.id"),
        "pick_root": _with("ppl", "edge", "clos", body="SELECT p.id AS root_id, count(c.ancestor_id) AS ancestors FROM ppl p LEFT JOIN clos c USING (id) GROUP BY p.id ORDER BY 2 DESC, 1 LIMIT 1"),
        "fractional_shares": _with(*NODES, "reg", "frac", body="SELECT * FROM frac"),
        "headcount_shares": _with(*NODES, "reg", body="SELECT granularity, region, count(*) AS value, row_number() OVER (PARTITION BY granularity ORDER BY count(*) DESC, min(path_key)) AS rank FROM reg GROUP BY granularity, region"),
        "place_variants": _with(*NODES, "vars", body="SELECT region, array_to_string(variants, ',') AS variants FROM vars"),
        "stub_resolve": _with("ppl", "toks", body=f"""SELECT p.id, s.country AS modern_country, s.country AS historical_polity, s.culture AS cultural_region, CASE WHEN s.country IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
            CASE WHEN coalesce(trim(p.place), '') = '' THEN 'stub:empty' WHEN s.country IS NULL THEN 'stub:no-alias-match' ELSE 'stub:alias("' || s.alias || '")' END AS provenance
            FROM ppl p LEFT JOIN (SELECT t.id, arg_max(a.alias, pos) AS alias, arg_max(a.country, pos) AS country, arg_max({{'c': a.culture}}, pos).c AS culture FROM toks t JOIN (SELECT * FROM {stub} v(alias, country, culture)) a ON a.alias = lower(t.t) GROUP BY t.id) s USING (id)"""),
        "geocode_first_token": _with("ppl", "gaz", "toks", "geo", body="SELECT DISTINCT place, h.token AS token, h.glat AS lat, h.glng AS lng, h.code AS country_code, h.gcountry AS modern_country FROM geo JOIN ppl USING (id)"),
        "canonical_country": _with("ppl", "gaz", "toks", "canon", "geo", "raw", "named", body="SELECT id, country_raw AS raw, country AS canonical, coalesce(country <> country_raw, false) AS changed FROM named", raw="SELECT p.id, p.place, p.year, p.lat, p.lng, (SELECT arg_max(t, pos) FROM toks k WHERE k.id = p.id) AS country_raw FROM ppl p"),
        "snapshot_asof": _with("ppl", "pol", "snap", body="SELECT id, p.year, s.snapshot_year FROM snap s JOIN ppl p USING (id)"),
        "temporal_pip": _with("ppl", "pol", "snap", body="SELECT p.id, arg_min(o.name, o.ord) AS subjecto, arg_min(o.part_of, o.ord) AS part_of, arg_min(o.snapshot_year, o.ord) AS snapshot_year FROM ppl p JOIN snap s USING (id) LEFT JOIN pol o ON o.snapshot_year = s.snapshot_year AND p.lng BETWEEN o.w AND o.e AND p.lat BETWEEN o.s AND o.n WHERE p.lat IS NOT NULL GROUP BY p.id"),
        "country_at_point": _with("ppl", "box", "ptc", body="SELECT * FROM ptc"),
        "country_in_rings": _with("ppl", body=f"SELECT id, CASE {_shapes()} END AS point_country FROM ppl WHERE lat IS NOT NULL"),
        "coord_contradiction": _with("ppl", *RESOLVE[:11], body="SELECT * FROM contra"),
        "ancient_rule": _with("ppl", "anc", body="SELECT * FROM anc"),
        "historical_resolve": _with("ppl", *RESOLVE, body="SELECT * FROM res"),
        "parse_gdate": f"SELECT *, TRY_CAST(nullif(regexp_extract(raw, '\\b([0-9]{{3,4}})\\b', 1), '') AS INT) AS year, regexp_matches(raw, '(?i)\\b(ABT|EST|CAL|BET|BEF|AFT|FROM|TO)\\b') AS approximate FROM ({_raw(derived.DATES)})",
        "parse_coords": f"SELECT *, CASE WHEN {side} IN ('S', 'W') THEN -abs({number}) WHEN {side} IN ('N', 'E') THEN abs({number}) ELSE {number} END AS value FROM ({_raw(derived.COORDS)})",
        "parse_names": f"SELECT *, CASE WHEN {slashed} THEN {part(1)} ELSE nullif(trim(raw), '') END AS given, CASE WHEN {slashed} THEN {part(2)} END AS surname FROM ({_raw(derived.NAMES)})",
        "gedcom_individuals": _with("ppl", body=f"SELECT '@I' || k || '@' AS id, given, nullif(surname, '') AS surname, CASE k % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'U' END AS sex, 1 AS n_events, year, nullif(place, '') AS place, lat, lng, CASE WHEN {some} THEN '@F' || k || '@' END AS famc FROM ppl"),
        "gedcom_families": _with("ppl", body=f"SELECT '@F' || k || '@' AS id, '@I' || father || '@' AS husband, '@I' || mother || '@' AS wife, '@I' || k || '@' AS children FROM ppl WHERE {some}"),
        "gedcom_parents": _with("ppl", body="SELECT '@I' || k || '@' AS id, '@I' || father || '@' AS father, '@I' || mother || '@' AS mother FROM ppl"),
        "display_names": _with("ppl", body="SELECT id, coalesce(nullif(concat_ws(' ', nullif(given, ''), nullif(surname, '')), ''), id::VARCHAR) AS name FROM ppl"),
        "first_birth": _with("ppl", body="SELECT '@I' || k || '@' AS id, nullif(place, '') AS place, year, lat, lng FROM ppl"),
        "depth_filter": _with(*WALK, body="SELECT id, min_depth FROM node WHERE min_depth <= 4"),
        "placed_filter": _with(*NODES, body="SELECT id, coord_lat AS lat, coord_lng AS lng FROM rnode WHERE coord_lat IS NOT NULL"),
        "spread_overlaps": _with(*NODES, "seen", "spread", body="SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM spread"),
        "map_points": _with(*NODES, "seen", "spread", body="SELECT s.id, round(s.lat, 6) AS lat, round(s.lng, 6) AS lng, contribution_weight AS weight, min_depth AS depth, is_leaf, coalesce(nullif(concat_ws(' ', nullif(p.given, ''), nullif(p.surname, '')), ''), p.id::VARCHAR) || ' — ' || coalesce(s.place, 'unknown') || CASE WHEN s.year IS NULL OR s.year = 0 THEN '' ELSE ' (' || s.year || ')' END AS label, modern_country AS region FROM spread s JOIN ppl p USING (id)"),
        "migration_arcs": _with(*NODES, "seen", "spread", "arcs", body="SELECT child_id, parent_id, weight, depth, round(km, 3) AS distance_km, km >= 1500 AS long_haul, region FROM arcs"),
        "isolate_arcs": _with(*NODES, "seen", "spread", "arcs", body="SELECT child_id, parent_id, region FROM arcs WHERE region IN ('Norway', 'Finland')"),
        "isolate_points": _with(*NODES, body="SELECT id, modern_country AS region, coalesce(modern_country IN ('Norway', 'Finland'), false) AS included FROM rnode WHERE coord_lat IS NOT NULL"),
        "great_circle": _with("ppl", body="SELECT id, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * pow(sin(radians(-0.12 - lng) / 2), 2)))), 3) AS km FROM ppl WHERE lat IS NOT NULL"),
        "unresolved_top10": _with(*NODES, body="SELECT place, count(*) AS people, row_number() OVER (ORDER BY count(*) DESC, min(path_key)) AS rank FROM rnode WHERE place <> '' AND coord_lat IS NULL GROUP BY place QUALIFY rank <= 10"),
        "deepest_generation": _with(*WALK, body="SELECT greatest(0, (SELECT max(depth) FROM visit), (SELECT coalesce(max(depth), 0) FROM gap))::INT AS deepest"),
        "slider_ceiling": _with(*WALK, body="SELECT greatest(8, (SELECT max(depth) FROM visit), (SELECT coalesce(max(depth), 0) FROM gap))::INT AS ceiling"),
        "top_shares_with_rest": _with(*NODES, "reg", "frac", body="SELECT rank, region, value AS fractional, greatest((SELECT count(*) FROM frac WHERE granularity = 'historicalPolity') - 8, 0) AS hidden FROM frac WHERE granularity = 'historicalPolity' AND rank <= 8"),
        "coverage_hundred_pct": _with(*NODES, "cov", body="SELECT part, weight, (fl + CASE WHEN rk <= 1000 - total THEN 1 ELSE 0 END) / 10.0::DOUBLE AS percent FROM (SELECT *, sum(fl) OVER () AS total, row_number() OVER (ORDER BY t - fl DESC, i) AS rk FROM (SELECT *, floor(t) AS fl FROM (SELECT *, weight / sum(weight) OVER () * 1000 AS t FROM (SELECT 0 AS i, 'resolved' AS part, resolved_weight AS weight FROM cov UNION ALL SELECT 1, 'unknown', unresolved_weight + gap_weight FROM cov))))"),
        "share_labels": _with(*WALK, body="SELECT id, CASE WHEN p <= 0 THEN '0%' WHEN p < 0.01 THEN '<0.01%' WHEN p < 0.1 THEN printf('%.2f', floor(p * 100 + 0.5) / 100) || '%' ELSE printf('%.1f', floor(p * 10 + 0.5) / 10) || '%' END AS label FROM (SELECT id, contribution_weight * 100 AS p FROM node)"),
        "range_select": _with(*NODES, "reg", "frac", body="SELECT rank, region FROM frac, (SELECT max(rank) FILTER (region = 'Norway') AS a, max(rank) FILTER (region = 'Finland') AS b FROM frac WHERE granularity = 'modernCountry') WHERE granularity = 'modernCountry' AND rank BETWEEN least(a, b) AND greatest(a, b)"),
        "variants_of_people": _with(*NODES, "vars", body="SELECT n.id, coalesce(array_to_string(v.variants, ','), '') AS variants FROM rnode n LEFT JOIN vars v ON v.region = n.modern_country"),
    }
