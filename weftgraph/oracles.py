"""The same queries in plain SQL over the test tables, written apart from the DataFrame code."""

from __future__ import annotations

K = 4

SUPPLY = "e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem)"
FLOW = "e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
CHAIN = "e AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
GEO = """e AS (SELECT (n_nationkey + 100)::BIGINT AS src, n_regionkey::BIGINT AS dst FROM nation
    UNION ALL SELECT c_custkey + 1000, (c_nationkey + 100)::BIGINT FROM customer UNION ALL SELECT s_suppkey + 10000000, (s_nationkey + 100)::BIGINT FROM supplier)"""
VERTS = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
SYM = """s AS (SELECT src, dst, false AS is_virtual FROM e
    UNION ALL SELECT dst, src, true FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src))"""
DEG = """g AS (SELECT id, out_deg, coalesce(in_deg, 0) AS in_deg, out_deg + coalesce(in_deg, 0) AS deg, sym_deg
    FROM (SELECT src AS id, count(*) FILTER (NOT is_virtual) AS out_deg, count(*) AS sym_deg FROM s GROUP BY src) a
    LEFT JOIN (SELECT dst AS id, count(*) AS in_deg FROM e GROUP BY dst) b USING (id))"""
LAB = f"l AS (SELECT DISTINCT src AS id, (src % {K})::INT AS part FROM s)"
#: Edges with the labels of both ends, then by vertex and by part.
STATS = f"""j AS (SELECT s.*, a.part AS ps, b.part AS pd FROM s JOIN l a ON a.id = s.src JOIN l b ON b.id = s.dst),
  w AS (SELECT src, ps, count(*) AS sd, count(*) FILTER (NOT is_virtual) AS od, count(*) FILTER (ps = pd) AS ls, count(*) FILTER (ps = pd AND NOT is_virtual) AS lr,
        count(DISTINCT pd) FILTER (ps <> pd) AS cs, count(DISTINCT pd) FILTER (ps <> pd AND NOT is_virtual) AS cr FROM j GROUP BY src, ps),
  p AS (SELECT r.part::INT AS part, count(src) AS vertices, coalesce(sum(od), 0)::BIGINT AS real_load, coalesce(sum(sd), 0)::BIGINT AS sym_load, coalesce(sum(lr), 0)::BIGINT AS lr, coalesce(sum(ls), 0)::BIGINT AS ls,
        coalesce(sum(cr), 0)::BIGINT AS cr, coalesce(sum(cs), 0)::BIGINT AS cs, coalesce(sum(least({K}, od)), 0)::BIGINT AS crm, coalesce(sum(least({K}, sd)), 0)::BIGINT AS csm
        FROM range({K}) r(part) LEFT JOIN w ON w.ps = r.part GROUP BY r.part),
  a AS (SELECT *, CASE WHEN vertices > 0 THEN real_load / vertices ELSE 0 END::DOUBLE AS avg_real, CASE WHEN vertices > 0 THEN sym_load / vertices ELSE 0 END::DOUBLE AS avg_sym FROM p)"""
QUALITY = ", ".join((SUPPLY, SYM, LAB, STATS))
MEASURES = f"""m AS (SELECT measure, x / sum(x) OVER (PARTITION BY measure) AS q, 1.0::DOUBLE / {K} AS u FROM (
    UNPIVOT (SELECT real_load::DOUBLE AS real_load, sym_load::DOUBLE AS sym_load, vertices::DOUBLE AS vertices, avg_real, avg_sym FROM a) ON COLUMNS(*) INTO NAME measure VALUE x))"""


def u(seed: int, step: int, tag: str, *keys: str) -> str:
    """A reproducible uniform."""
    text = f"'{seed}:{step}:{tag}'" + "".join(f" || ':' || {k}" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sup(*more: str) -> str:
    return "WITH " + ", ".join((SUPPLY, SYM, DEG, LAB, *more))


def flow(*more: str) -> str:
    return "WITH " + ", ".join((FLOW, SYM, DEG, *more))


def ceil3(a: str, b: str) -> str:
    return f"((({a}) * 1000 + {b} - 1) // ({b}))::DOUBLE / 1000.0::DOUBLE"


TOTALS = "t AS (SELECT sum(out_deg)::BIGINT AS e, sum(sym_deg)::BIGINT AS m, count(*)::BIGINT AS n FROM g)"
COUNTS = """c AS (SELECT s.src AS id, i.label::INT AS label, count(*) FILTER (b.part = i.label) AS f, count(*) FILTER (b.part = i.label AND NOT is_virtual) AS r,
    count(b.part) AS labelled, count(*) FILTER (NOT is_virtual) AS rt FROM s JOIN l b ON b.id = s.dst CROSS JOIN range(4) i(label) GROUP BY s.src, i.label)"""
UNIT = {"edge": ("out_deg", "e"), "vertex": ("1", "n"), "baseline": ("sym_deg", "m")}


def loads(kind: str) -> str:
    return f"lo AS (SELECT i.label, coalesce(sum({UNIT[kind][0]}) FILTER (l.id IS NOT NULL), 0)::BIGINT AS load FROM range({K}) i(label) LEFT JOIN l ON l.part = i.label LEFT JOIN g ON g.id = l.id GROUP BY i.label)"


def scored(kind: str) -> str:
    share = "CASE WHEN labelled > 0 THEN f::DOUBLE / labelled ELSE 0 END"
    capacity = f"floor((SELECT {UNIT[kind][1]} FROM t) * 1.05::DOUBLE / {K} + 0.5)::BIGINT"
    if kind == "vertex":
        h = f"1.0::DOUBLE + {share} + (0.5::DOUBLE * CASE WHEN rt > 0 THEN r::DOUBLE / rt ELSE 0 END - 0.5::DOUBLE * {ceil3('load', '(SELECT n FROM t)')})"
    else:
        h = f"1.0::DOUBLE + {share} - {ceil3('load', capacity)}"
    return f"{loads(kind)}, h AS (SELECT c.id, c.label, c.f, round({h}, 12) AS h FROM c JOIN lo ON lo.label = c.label)"


def choice(tag_step: int, labelled_only: bool = False) -> str:
    only = "WHERE h.f > 0" if labelled_only else ""
    draw = u(1, tag_step, "tie", "h.id", "h.label")
    return f"""k AS (SELECT id, label AS nxt FROM (SELECT h.id, h.label, row_number() OVER (PARTITION BY h.id ORDER BY h.h DESC, coalesce(l.part = h.label, false) DESC, {draw} DESC, h.label) AS o
        FROM h LEFT JOIN l ON l.id = h.id {only}) WHERE o = 1),
      x AS (SELECT v.id, l.part AS cur, k.nxt FROM (SELECT id FROM g) v LEFT JOIN l ON l.id = v.id LEFT JOIN k ON k.id = v.id)"""


FIRST = ", ".join((TOTALS, COUNTS, scored("edge"), choice(1)))
ASKS = "d AS (SELECT nxt AS label, count(*) AS requests, sum(out_deg)::BIGINT AS demand FROM x JOIN g USING (id) WHERE nxt <> cur GROUP BY nxt)"
CHANCE = f"""ch AS (SELECT lo.label, CASE WHEN coalesce(demand, 0) = 0 OR load >= cap THEN 0 ELSE least(1.0::DOUBLE, (cap - load)::DOUBLE / demand) END AS p
    FROM (SELECT *, floor((SELECT e FROM t) * 1.05::DOUBLE / {K} + 0.5)::BIGINT AS cap FROM lo) lo LEFT JOIN d USING (label)),
  ad AS (SELECT x.id, cur, nxt, nxt <> cur AND {u(1, 1, 'admit', 'x.id')} < p AS moved FROM x JOIN ch ON ch.label = x.nxt)"""
HUB = f"l AS (SELECT id, CASE WHEN out_deg > (SELECT ceil(sum(out_deg) / count(*)) FROM g) THEN floor({u(1, 0, 'hub', 'id')} * {K})::INT END AS part FROM g)"
HUB_FIRST = ", ".join((SUPPLY, SYM, DEG, HUB, TOTALS, COUNTS, scored("edge"), choice(0, True)))


def top_share(source: str, value: str, share: float, columns: str) -> str:
    return f"""hi AS (SELECT {value}, count(*) AS n FROM {source} GROUP BY {value}),
      cu AS (SELECT {value}, n, coalesce(sum(n) OVER (ORDER BY {value} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT floor(count(*) * {share}::DOUBLE)::BIGINT + 1 FROM {source}) AS wanted FROM hi)
    SELECT {columns} FROM {source} y JOIN cu USING ({value}) WHERE before < wanted AND {u(1, 0, 'seed', 'y.id')} < least(1.0::DOUBLE, (wanted - before)::DOUBLE / n)"""


CLUSTER = """q AS (SELECT a.src AS id, count(*) AS links FROM s a JOIN s b ON b.src = a.src JOIN s c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
  cc AS (SELECT g.id, sym_deg AS degree, coalesce(links, 0) AS links FROM g LEFT JOIN q USING (id))"""
BUCKET = "floor(links * 1000 / greatest(degree * (degree - 1), 1))::INT"


def held(table: str) -> str:
    """A graph or vertex table that is computed once, however often it is read."""
    return table.replace(" AS (", " AS MATERIALIZED (", 1)


def pagerank(steps: int = 30) -> str:
    parts = [held(SUPPLY), held(VERTS), "o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src)", "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    for i in range(1, steps + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(sum(r.rank / o.n), 0) AS rank FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN r{i - 1} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 9) AS rank FROM r{steps}"


def walk(graph: str, bias: str, steps: int = 30) -> str:
    """Steps up to the first, from the second on, that changes less than 1e-5 in all."""
    parts = [held(graph), held(VERTS), "o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, steps + 1):
        mass = "1.0::DOUBLE" if i == 1 else f"(SELECT sum(rank) FROM r{i - 1})"
        lost = f"coalesce((SELECT sum(rank) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)), 0)"
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.id, (0.85::DOUBLE * (coalesce(sum(r.rank / o.n), 0) + {lost} / (SELECT count(*) FROM v)) + {bias}) / {mass} AS rank FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN r{i - 1} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id)")
    changes = " UNION ALL ".join(f"SELECT {i} AS step, sum(abs(a.rank - b.rank)) AS change FROM r{i} a JOIN r{i - 1} b ON a.id = b.id" for i in range(2, steps + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS step, * FROM r{i}" for i in range(2, steps + 1))
    return f"WITH {', '.join(parts)}, h AS (SELECT coalesce(min(step), {steps}) AS last FROM ({changes}) WHERE change < 0.00001) SELECT id, round(rank, 9) AS rank FROM ({every}) JOIN h ON step = last"


COMPONENTS = f"""b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
  c AS (SELECT id, id AS label FROM v UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.id WHERE c.label < b.dst)
  SELECT id, min(label) AS component FROM c GROUP BY id"""
DIVERGE = "ln(q / ((q + u) / 2))"

def cycles(kind: str, n: int, init: str | list[str], k: int = K, weight: int = 1, directed: bool = True, first: bool = True, settle: bool = False) -> str:
    """Labels after n cycles of label propagation; init gives l0(id, part), first labels what has none.

    With settle the labels of the first cycle, of n at most, in which nothing moves or whose score is within a
    thousandth of the best of the three before."""
    unit, whole = UNIT[kind]
    whole = "m" if kind == "edge" and not directed else whole
    real = "NOT is_virtual" if directed else "true"
    parts = [held(x) for x in (SUPPLY, SYM, DEG, TOTALS, init)] if isinstance(init, str) else [*init[:-1], held(TOTALS), held(init[-1])]
    worth = f"CASE WHEN is_virtual THEN 1 ELSE {weight} END"
    cap = f"floor((SELECT {whole} FROM t) * 1.05::DOUBLE / {k} + 0.5)::BIGINT"

    def choose(i: int, labelled_only: bool) -> None:
        share = "CASE WHEN labelled > 0 THEN f::DOUBLE / labelled ELSE 0 END"
        if kind == "vertex":
            h = f"1.0::DOUBLE + {share} + (0.5::DOUBLE * CASE WHEN rt > 0 THEN r::DOUBLE / rt ELSE 0 END - 0.5::DOUBLE * {ceil3('load', '(SELECT n FROM t)')})"
        else:
            h = f"1.0::DOUBLE + {share} - {ceil3('load', cap)}"
        draw = u(1, i, "tie", "h.id", "h.label")
        parts.extend((
            f"c{i} AS MATERIALIZED (SELECT s.src AS id, i.label::INT AS label, coalesce(sum({worth}) FILTER (b.part = i.label), 0)::BIGINT AS f, count(*) FILTER (b.part = i.label AND {real}) AS r, coalesce(sum({worth}) FILTER (b.part IS NOT NULL), 0)::BIGINT AS labelled, count(*) FILTER ({real}) AS rt FROM s JOIN l{i} b ON b.id = s.dst CROSS JOIN range({k}) i(label) GROUP BY s.src, i.label)",
            f"lo{i} AS MATERIALIZED (SELECT i.label, coalesce(sum({unit}) FILTER (l.id IS NOT NULL), 0)::BIGINT AS load FROM range({k}) i(label) LEFT JOIN l{i} l ON l.part = i.label LEFT JOIN g ON g.id = l.id GROUP BY i.label)",
            f"h{i} AS MATERIALIZED (SELECT c.id, c.label, c.f, round({h}, 12) AS h FROM c{i} c JOIN lo{i} lo ON lo.label = c.label)",
            f"""x{i} AS MATERIALIZED (SELECT l.id, l.part AS cur, q.label AS nxt FROM l{i} l LEFT JOIN (SELECT h.id, h.label, row_number() OVER (PARTITION BY h.id ORDER BY h.h DESC, coalesce(l.part = h.label, false) DESC, {draw} DESC, h.label) AS o
                FROM h{i} h JOIN l{i} l ON l.id = h.id {"WHERE h.f > 0" if labelled_only else ""}) q ON q.id = l.id AND o = 1)""",
        ))

    if first:
        choose(0, True)
        parts.append(f"l1 AS MATERIALIZED (SELECT id, coalesce(nxt, cur, floor({u(1, 0, 'left', 'id')} * {k})::INT) AS part, true AS moved FROM x0)")
    else:
        parts.append("l1 AS MATERIALIZED (SELECT id, part, true AS moved FROM l0)")
    for i in range(1, n + 1):
        choose(i, False)
        heard = "true" if i == 1 else f"id IN (SELECT src FROM s JOIN l{i} b ON b.id = s.dst WHERE moved)"
        parts.extend((
            f"a{i} AS MATERIALIZED (SELECT *, nxt <> cur AND {heard} AS asks FROM x{i})",
            f"d{i} AS MATERIALIZED (SELECT nxt AS label, sum({unit})::BIGINT AS demand FROM a{i} JOIN g USING (id) WHERE asks GROUP BY nxt)",
            f"p{i} AS MATERIALIZED (SELECT lo.label, CASE WHEN coalesce(demand, 0) = 0 OR load >= {cap} THEN 0 ELSE least(1.0::DOUBLE, ({cap} - load)::DOUBLE / demand) END AS p FROM lo{i} lo LEFT JOIN d{i} USING (label))",
            f"l{i + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN asks AND {u(1, i, 'admit', 'a.id')} < p THEN nxt ELSE cur END AS part, asks AND {u(1, i, 'admit', 'a.id')} < p AS moved FROM a{i} a JOIN p{i} p ON p.label = a.nxt)",
        ))
    if not settle:
        return f"WITH {', '.join(parts)} SELECT id, part FROM l{n + 1}"
    parts += [f"z{i} AS MATERIALIZED (SELECT {i} AS step, (SELECT count(*) FROM l{i + 1} WHERE moved) AS n, (SELECT sum(h) FROM h{i} h JOIN l{i} l ON l.id = h.id AND l.part = h.label) AS score)" for i in range(1, n + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM z{i}" for i in range(1, n + 1))
    best = "max(score) OVER (ORDER BY step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    parts.append(f"y AS (SELECT step, n, score, {best} AS best FROM ({every})), last AS (SELECT coalesce(min(step), {n}) AS last FROM y WHERE n = 0 OR step > 3 AND best > 0 AND abs(1 - score / best) < 0.001)")
    labels = " UNION ALL ".join(f"SELECT {i} AS step, id, part FROM l{i + 1}" for i in range(1, n + 1))
    return f"WITH {', '.join(parts)} SELECT id, part FROM ({labels}) JOIN last ON step = last"


HUB0 = HUB.replace("l AS", "l0 AS", 1)
UNIFORM0 = f"l0 AS (SELECT id, floor({u(1, 0, 'init', 'id')} * {K})::INT AS part FROM g)"
GROW0 = f"l0 AS (SELECT id, CASE WHEN {u(1, 0, 'move', 'id')} < 2 / 6.0::DOUBLE THEN 4 + floor({u(1, 0, 'to', 'id')} * 2)::INT ELSE (id % {K})::INT END AS part FROM g)"


def samples(kind: str, n: int = 6, beta: float = 0.15, sigma: float = 0.05, tau: int = 3) -> str:
    """(id, cycle) after at most n cycles of a sampler on the flow graph."""
    return f"WITH {', '.join(sampled(kind, n, FLOW, beta, sigma, tau))} SELECT id, cycle FROM t{n}"


#: Labels dealt in turn to the sample; if it stayed too small, random ones to it and to hubs.
SAMPLED0 = f"""l0 AS (SELECT g.id, CASE WHEN (SELECT count(*) FROM t50) >= (SELECT target FROM w) THEN r.part WHEN r.id IS NOT NULL OR out_deg > (SELECT ceil(sum(out_deg) / count(*)) FROM g) THEN floor({u(1, 0, 'hub', 'g.id')} * {K})::INT END AS part
    FROM g LEFT JOIN (SELECT id, ((row_number() OVER (ORDER BY {u(1, 0, 'sampled', 'id')}, id) - 1) % {K})::INT AS part FROM t50) r ON r.id = g.id)"""


def sampled(kind: str, n: int, graph: str, beta: float = 0.15, sigma: float = 0.05, tau: int = 3) -> list[str]:
    """The tables of a sampler's run; t{n} has the sample."""
    seeds = {
        "rd": f"SELECT id FROM g WHERE {u(1, 0, 'seed', 'id')} < {sigma}::DOUBLE",
        "hd": f"SELECT y.id FROM g y JOIN cu USING (deg) WHERE before < wanted AND {u(1, 0, 'seed', 'y.id')} < least(1.0::DOUBLE, (wanted - before)::DOUBLE / n)",
        "cc": f"SELECT y.id FROM bu y JOIN cu USING (bucket) WHERE before < wanted AND {u(1, 0, 'seed', 'y.id')} < least(1.0::DOUBLE, (wanted - before)::DOUBLE / n)",
        "gd": f"SELECT id FROM g JOIN pr ON pr.degree = g.deg WHERE {u(1, 0, 'seed', 'id')} < p * {sigma}::DOUBLE * v / (SELECT sum(n * p) FROM pr)",
    }[kind]
    parts = [held(x) for x in (graph, SYM, DEG)]
    if kind == "cc":
        q, cc = CLUSTER.split(",\n  cc AS")
        parts += [held(q), f"cc AS MATERIALIZED{cc}", f"bu AS MATERIALIZED (SELECT id, {BUCKET} AS bucket FROM cc)"]
    if kind in ("hd", "cc"):
        of, value = ("g", "deg") if kind == "hd" else ("bu", "bucket")
        parts.append(f"hi AS (SELECT {value}, count(*) AS n FROM {of} GROUP BY {value})")
        parts.append(f"cu AS MATERIALIZED (SELECT {value}, n, coalesce(sum(n) OVER (ORDER BY {value} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT floor(count(*) * {sigma}::DOUBLE)::BIGINT + 1 FROM {of}) AS wanted FROM hi)")
    if kind == "gd":
        parts.append("f AS (SELECT deg AS degree, count(*) AS n FROM g GROUP BY deg), z AS (SELECT sum(n)::DOUBLE AS v FROM f), pr AS MATERIALIZED (SELECT degree, n, n / v AS p, v FROM f, z)")
    parts += [f"w AS MATERIALIZED (SELECT greatest({K}, floor(count(*) * {beta}::DOUBLE)::BIGINT + 1) AS target FROM g)", f"t0 AS MATERIALIZED (SELECT id, 0 AS cycle FROM ({seeds}))", "o0 AS MATERIALIZED (SELECT id FROM t0)"]
    for i in range(1, n + 1):
        asked = f"SELECT s.src AS asker, s.dst AS id, g.deg FROM s JOIN o{i - 1} a ON a.id = s.src JOIN g ON g.id = s.dst WHERE s.dst NOT IN (SELECT id FROM t{i - 1})"
        if kind == "gd":
            told = f"SELECT q.asker, q.id FROM ({asked}) q JOIN pr ON pr.degree = q.deg WHERE {u(1, i, 'spread', 'q.asker', 'q.id')} < p + (1 - (SELECT max(p) FROM pr)) / 2"
        else:
            told = f"SELECT asker, id FROM (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY deg DESC, id) AS r FROM ({asked})) WHERE r <= {tau}"
        parts += [
            f"n{i} AS MATERIALIZED (SELECT id, count(*) AS n FROM ({told}) GROUP BY id)",
            f"j{i} AS MATERIALIZED (SELECT id, {i} AS cycle FROM n{i} WHERE (SELECT count(*) FROM t{i - 1}) < (SELECT target FROM w) AND {u(1, i, 'join', 'id')} < least(1.0::DOUBLE, ((SELECT target FROM w) - (SELECT count(*) FROM t{i - 1}))::DOUBLE / (SELECT sum(n) FROM n{i})))",
            f"t{i} AS MATERIALIZED (SELECT * FROM t{i - 1} UNION ALL SELECT * FROM j{i})",
            f"o{i} AS MATERIALIZED (SELECT id FROM t{i} WHERE cycle = {i} OR NOT EXISTS (SELECT 1 FROM j{i}))",
        ]
    return parts


def report(facts: dict[str, str]) -> str:
    """The 87 lines of a run report on the supply graph under the labels id mod K."""
    three, six, long = (lambda x: f"printf('%.3f', ({x})::DOUBLE)"), (lambda x: f"printf('%.6f', ({x})::DOUBLE)"), (lambda x: f"printf('%.8f', ({x})::DOUBLE)")
    js = lambda m: f"(SELECT sum(CASE WHEN q > 0 THEN q * {DIVERGE} ELSE 0 END + u * ln(u / ((q + u) / 2))) / (2 * ln(2)) FROM m WHERE measure = '{m}')"
    kl = lambda m: f"(SELECT CASE WHEN min(q) <= 0 THEN -1 ELSE sum(q * ln(q / u)) / ln({K}) END FROM m WHERE measure = '{m}')"
    ka = lambda m: f"(SELECT CASE WHEN min(q) <= 0 THEN -1 ELSE abs(sum(q * ln(q / u))) END FROM m WHERE measure = '{m}')"
    joined = lambda c: f"(SELECT string_agg({c} || '_', '' ORDER BY part) FROM a)"
    of = lambda x: f"(SELECT {x} FROM a)"
    rows = [("JOB ID", None), ("JOB NAME", None), ("WORKERS", None), ("ALGORITHM", None), ("GRAPH", None), ("VERTICES", of("sum(vertices)::BIGINT")), ("REAL EDGES", of("sum(real_load)::BIGINT")), ("VIRTUAL EDGES", of("sum(sym_load)::BIGINT")), ("PARITIONS", str(K)),
        ("REAL LOADS", joined("real_load")), ("VIRTUAL LOADS", joined("sym_load")), ("VIRTUAL COUNTS", joined("vertices")), ("REAL KLU", long(kl("real_load"))), ("VIRTUAL KLU", long(kl("sym_load"))), ("VIRTUAL COUNT KLU", long(kl("vertices"))), ("REAL AVGD KLU", long(ka("avg_real"))), ("VIRTUAL AVGD KLU", long(ka("avg_sym"))), ("", None)]
    for kind, gap, jsd, load, avg, lo, cv in (("REAL", "", "EB", "real_load", "avg_real", "lr", "cr"), ("VIRTUAL", " ", "ED", "sym_load", "avg_sym", "ls", "cs")):
        norm = lambda c: of(f"max({c}) * {K} / sum({c})::DOUBLE")
        rows += [(f"{kind} E MAXNORM{gap}LOAD", three(norm(load))), (f"{kind} E MAXMIN{gap}LOAD", three(of(f"max({load}) / min({load})"))), (f"{kind} {jsd} JSD", six(js(load))), (f"{kind} E KLU", six(kl(load))),
            (f"{kind} V MAXNORM{gap}LOAD", three(norm("vertices"))), (f"{kind} V MAXMIN{gap}LOAD", three(of("max(vertices) / min(vertices)"))), (f"{kind} VB JSD", six(js("vertices"))), (f"{kind} V KLU", six(kl("vertices"))),
            (f"{kind} AVGD MAXNORM", three(of(f"max({avg}) / (sum({load})::DOUBLE / sum(vertices)::DOUBLE)"))), (f"{kind} AVGD MAXMIN", three(of(f"max({avg}) / min({avg})"))), (f"{kind} AVGDB JSD", six(js(avg))), (f"{kind} AVGD KLU", six(ka(avg))),
            (f"{kind} EC PCT", three(of(f"(sum({load}) - sum({lo})) / sum({load})::DOUBLE"))), (f"{kind} COMMVOL PCT", three(of(f"sum({cv})::DOUBLE / sum({cv}m)"))), (f"{kind} LOCE PCT", three(of(f"sum({lo}) / sum({load})::DOUBLE"))),
            (f"{kind} EC", of(f"(sum({load}) - sum({lo}))::BIGINT")), (f"{kind} COMMVOL", of(f"sum({cv})::BIGINT")), (f"{kind} LOCE", of(f"sum({lo})::BIGINT")), (f"{kind} COMMVOL NORMF", of(f"sum({cv}m)::BIGINT"))]
        rows += [("REAL SCORE", None)] if kind == "REAL" else []
    run = "|SAMPLING START|SAMPLING END|SAMPLING CYCLES|SAMPLING EXTRA|LP START|LP END|LP CYCLES|TOT MIGRATIONS||INITIAL MESSAGES|SAMPLING MESSAGES|LP MESSAGES|SHUTDOWN MESSAGES|TOTAL MESSAGES||INPUT TIME (not included in total)|INITIALIZE TIME|SETUP TIME|Initializing algorithm time|LP time|Avg. LP cycle time|Sampling time|Avg. Sampling cycle time|TOTAL TIME|OUT DEGREE THRESHOLD|BETA|SIGMA|TAU|SAMPLING_ERROR"
    rows += [(name, None) for name in run.split("|")]
    told = lambda name, x: f"({x})::VARCHAR" if x else "NULL" if not name else f"'{facts.get(name, '')}'"
    return f"WITH {QUALITY}, {MEASURES} " + " UNION ALL ".join(f"SELECT {i}::INT AS line, '{name}' AS metric, {told(name, x)} AS value" for i, (name, x) in enumerate(rows))


DEADLOCK = """n AS MATERIALIZED (SELECT (n_nationkey + 100)::BIGINT AS id, n_regionkey::BIGINT AS region FROM nation),
  w AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT src, dst, src % 3 AS tag FROM e UNION ALL SELECT region, id, 0 FROM n WHERE region < 2 AND id % 2 = 0 UNION ALL SELECT 99, id, id % 3 FROM n)),
  v AS MATERIALIZED (SELECT src AS id FROM w UNION SELECT dst FROM w),
  r AS (SELECT 99::BIGINT AS id UNION SELECT w.dst FROM r JOIN w ON w.src = r.id),
  f0 AS MATERIALIZED (SELECT id FROM r WHERE id NOT IN (SELECT src FROM w))"""


def deadlock(rounds: int = 6) -> str:
    """What is free after so many rounds of grants; waits here are four deep."""
    parts = [f"f{i} AS MATERIALIZED (SELECT id FROM f{i - 1} UNION SELECT src FROM (SELECT src, tag FROM w WHERE src IN (SELECT id FROM r) GROUP BY src, tag HAVING count(*) = count(*) FILTER (dst IN (SELECT id FROM f{i - 1}))))" for i in range(1, rounds + 1)]
    return f"WITH RECURSIVE {GEO}, {DEADLOCK}, {', '.join(parts)} SELECT id, id IN (SELECT id FROM r) AS notified, id IN (SELECT id FROM f{rounds}) AS free FROM v"


def supersteps(n: int = 6) -> str:
    """A ring of ten: each step edges gain their source's value and vertices what their edges hold."""
    parts = ["v0 AS (SELECT i AS id, i AS value FROM range(10) r(i)), e0 AS (SELECT i AS src, (i + 1) % 10 AS dst, 0.0::DOUBLE AS w FROM range(10) r(i))"]
    for i in range(1, n + 1):
        parts += [f"e{i} AS MATERIALIZED (SELECT src, dst, w + value AS w FROM e{i - 1} JOIN v{i - 1} ON id = src)", f"v{i} AS MATERIALIZED (SELECT id, value + coalesce(sum(w), 0)::BIGINT AS value FROM v{i - 1} LEFT JOIN e{i} ON dst = id GROUP BY id, value)"]
    return f"WITH {', '.join(parts)} SELECT id, value FROM v{n}"


SQL = {
    "quality_partition_loads": f"WITH {QUALITY} SELECT part, vertices, real_load, sym_load FROM p",
    "quality_edge_cut": f"""WITH {QUALITY}, z AS (SELECT sum(real_load)::BIGINT AS e, sum(sym_load)::BIGINT AS m, sum(lr)::BIGINT AS lr, sum(ls)::BIGINT AS ls FROM p)
        SELECT lr AS local_real, e - lr AS cut_real, round((e - lr) / e, 9) AS cut_real_share, round(lr / e, 9) AS local_real_share, ls AS local_sym, m - ls AS cut_sym, round((m - ls) / m, 9) AS cut_sym_share, round(ls / m, 9) AS local_sym_share FROM z""",
    "quality_comm_volume": f"""WITH {QUALITY} SELECT sum(cr)::BIGINT AS cv_real, sum(crm)::BIGINT AS cv_real_max, round(sum(cr)::DOUBLE / sum(crm), 9) AS cv_real_share,
        sum(cs)::BIGINT AS cv_sym, sum(csm)::BIGINT AS cv_sym_max, round(sum(cs)::DOUBLE / sum(csm), 9) AS cv_sym_share FROM p""",
    "quality_balance_ratios": f"""WITH {QUALITY} SELECT round(max(real_load) * {K} / sum(real_load)::DOUBLE, 9) AS edge_max_norm, round(max(real_load) / min(real_load), 9) AS edge_max_min,
        round(max(sym_load) * {K} / sum(sym_load)::DOUBLE, 9) AS sym_max_norm, round(max(sym_load) / min(sym_load), 9) AS sym_max_min,
        round(max(vertices) * {K} / sum(vertices)::DOUBLE, 9) AS vertex_max_norm, round(max(vertices) / min(vertices), 9) AS vertex_max_min,
        round(max(avg_real) / (sum(real_load)::DOUBLE / sum(vertices)::DOUBLE), 9) AS avg_max_norm, round(max(avg_real) / min(avg_real), 9) AS avg_max_min,
        round(max(avg_sym) / (sum(sym_load)::DOUBLE / sum(vertices)::DOUBLE), 9) AS avg_sym_max_norm, round(max(avg_sym) / min(avg_sym), 9) AS avg_sym_max_min FROM a WHERE vertices > 0""",
    "quality_jsd": f"WITH {QUALITY}, {MEASURES} SELECT measure, round(sum(CASE WHEN q > 0 THEN q * {DIVERGE} ELSE 0 END + u * ln(u / ((q + u) / 2))) / (2 * ln(2)), 9) AS jsd FROM m GROUP BY measure",
    "quality_kl": f"""WITH {QUALITY}, {MEASURES} SELECT measure, round(CASE WHEN min(q) <= 0 THEN -1 ELSE sum(q * ln(q / u)) / ln({K}) END, 9) AS kl_log_k,
        round(CASE WHEN min(q) <= 0 THEN -1 ELSE abs(sum(q * ln(q / u))) END, 9) AS kl_abs FROM m GROUP BY measure""",
    "quality_avg_degree": f"WITH {QUALITY} SELECT part, round(avg_real, 9) AS avg_real, round(avg_sym, 9) AS avg_sym FROM a",
    "out_degree": f"WITH {SUPPLY}, {VERTS} SELECT id, count(e.dst) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY id",
    "in_degree": f"WITH {SUPPLY}, {VERTS} SELECT id, count(e.src) AS in_degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY id",
    "graph_totals": f"{sup()} SELECT sum(out_deg)::BIGINT AS n_edges, count(*) AS n_vertices, max(sym_deg) AS max_degree FROM g",
    "degree_distribution": f"{sup()} SELECT deg AS degree, count(*) AS n FROM g GROUP BY deg",
    "out_degree_freq_capped": f"WITH {FLOW}, {VERTS} SELECT least(d, 100) AS degree, count(*) AS n FROM (SELECT id, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY id) GROUP BY 1",
    "symmetrize_flow": f"WITH {FLOW}, {SYM} SELECT src, dst, is_virtual FROM s",
    "reverse_duplicate": f"WITH {FLOW} SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
    "dedup_edges": f"WITH {SUPPLY} SELECT src, dst FROM e",
    "adjacency_export": f"WITH {FLOW}, {VERTS} SELECT id, coalesce(string_agg(dst::VARCHAR, chr(9) ORDER BY dst), '') AS neighbours FROM v LEFT JOIN e ON e.src = v.id GROUP BY id",
    "adjacency_partitioned": f"WITH {FLOW}, {SYM} SELECT src AS id, src || '_' || src % {K} || chr(9) || string_agg(dst || '_' || dst % {K}, chr(9) ORDER BY dst) AS line FROM s GROUP BY src",
    "adjacency_real_only": f"WITH {FLOW}, {VERTS} SELECT id, id || '_' || id % {K} || chr(9) || coalesce(string_agg(dst::VARCHAR, chr(9) ORDER BY dst), '') AS line FROM v LEFT JOIN e ON e.src = v.id GROUP BY id",
    "ring_generator": "SELECT i AS src, (i + 1) % 1000 AS dst, (i * 100)::FLOAT AS value FROM range(1000) r(i)",
    "ring_vertices": "SELECT i AS id, (i * 10)::DOUBLE AS value FROM range(1000) r(i)",
    "combiner_sum": f"WITH {SUPPLY} SELECT dst AS id, sum(1 + (src * 31 + dst) % 10)::DOUBLE AS total, 1 AS received FROM e GROUP BY dst",
    "message_delivery": f"WITH {SUPPLY} SELECT dst AS id, sum(1 + (src * 31 + dst) % 10)::DOUBLE AS total, count(*) AS received FROM e GROUP BY dst",
    "aggregate_kinds": f"WITH {SUPPLY}, x AS (SELECT src, (1 + (src * 31 + dst) % 10)::DOUBLE AS y FROM e) SELECT src, sum(y) AS sum_value, min(y) AS min_value, max(y) AS max_value FROM x GROUP BY src",
    "mutate_add_remove": f"""WITH {FLOW}, m AS (SELECT src, dst FROM e UNION SELECT dst, src + 1000000 FROM e WHERE dst % 5 = 0)
        SELECT src, dst FROM m WHERE src % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = m.src AND e.dst = m.dst AND (e.src + e.dst) % 7 = 0)""",
    "mutate_vertices": f"WITH {FLOW}, {VERTS} SELECT id FROM v WHERE id % 11 <> 0",
    "reset_labels": f"WITH {FLOW}, {VERTS} SELECT id, -1 AS part FROM v",
    "friends_list": f"""WITH {FLOW}, n AS (SELECT src, dst FROM e WHERE src <> dst), f AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS friends FROM n GROUP BY src) SELECT n.src, n.dst, friends FROM n JOIN f ON f.src = n.src""",
    "placement_hash": f"WITH {SUPPLY}, {VERTS} SELECT id, abs(id % 16)::INT AS part, (abs(id % 16) % 3)::INT AS worker FROM v",
    "placement_label": f"WITH {SUPPLY}, {VERTS} SELECT id, (id % {K})::INT AS part, (id % {K} % 3)::INT AS worker FROM v",
    "pagerank_simple": pagerank(),
    "pagerank_walk": walk(SUPPLY, "0.15::DOUBLE / (SELECT count(*) FROM v)"),
    "rwr": walk(FLOW, "CASE WHEN v.id % 10 = 1 THEN 0.15::DOUBLE / (SELECT count(*) FROM v WHERE id % 10 = 1) ELSE 0 END"),
    "connected_components": f"WITH RECURSIVE {CHAIN}, {VERTS}, {COMPONENTS}",
    "connected_components_geo": f"WITH RECURSIVE {GEO}, {VERTS}, {COMPONENTS}",
    "sssp": f"""WITH RECURSIVE {CHAIN}, {VERTS}, p AS (SELECT 1::BIGINT AS id, 0.0::DOUBLE AS distance WHERE 1 IN (SELECT src FROM e UNION ALL SELECT dst FROM e) UNION ALL SELECT e.dst, distance + 1 + (e.src * 31 + e.dst) % 10 FROM p JOIN e ON e.src = p.id)
        SELECT v.id, coalesce(min(distance), 1.7976931348623157e308) AS distance FROM v LEFT JOIN p ON p.id = v.id GROUP BY v.id""",
    "sssp_hops": f"""WITH RECURSIVE {SUPPLY}, {VERTS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), p AS (SELECT 1::BIGINT AS id, 0 AS hops UNION SELECT b.dst, hops + 1 FROM p JOIN b ON b.src = p.id WHERE hops < 8)
        SELECT v.id, coalesce(min(hops)::DOUBLE, 1.7976931348623157e308) AS distance FROM v LEFT JOIN p ON p.id = v.id GROUP BY v.id""",
    "max_propagation": f"""WITH RECURSIVE {GEO}, {VERTS}, a AS (SELECT id, id AS origin FROM v UNION SELECT e.dst, a.origin FROM a JOIN e ON e.src = a.id), o AS (SELECT id, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY id)
        SELECT a.id, max(o.d) AS value FROM a JOIN o ON o.id = a.origin GROUP BY a.id""",
    "triangle_closing": f"""WITH {FLOW}, t AS (SELECT a.dst AS id, b.dst AS candidate, count(*) AS common FROM e a JOIN e b ON a.src = b.src WHERE a.dst <> b.dst GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY common DESC, candidate)::INT AS rank FROM t""",
    "clustering_coefficient": f"{flow(CLUSTER)} SELECT id, degree, links, round(CASE WHEN degree > 1 THEN links / (degree * (degree - 1)) ELSE 0 END, 9)::DOUBLE AS cc FROM cc",
    "cc_histogram": f"{flow(CLUSTER)} SELECT {BUCKET} AS bucket, count(*) AS n FROM cc GROUP BY 1",
    "topk_neighbors": f"{flow()} SELECT * FROM (SELECT src AS id, dst AS neighbour, deg, row_number() OVER (PARTITION BY src ORDER BY deg DESC, dst)::INT AS rank FROM s JOIN g ON g.id = s.dst) WHERE rank <= 3",
    "init_uniform": f"WITH {SUPPLY}, {VERTS} SELECT id, floor({u(1, 0, 'init', 'id')} * {K})::INT AS part FROM v",
    "init_hub": f"WITH {SUPPLY}, {SYM}, {DEG}, {HUB} SELECT id, coalesce(part, -1) AS part FROM l",
    "repartition_grow": f"{sup()} SELECT id, CASE WHEN {u(1, 0, 'move', 'id')} < 2 / 6.0::DOUBLE THEN 4 + floor({u(1, 0, 'to', 'id')} * 2)::INT ELSE part END AS part FROM l",
    "repartition_shrink": f"{sup()} SELECT id, CASE WHEN part >= 2 THEN floor({u(1, 0, 'to', 'id')} * 2)::INT ELSE part END AS part FROM l",
    "seeds_hd": f"{sup()}, {top_share('g', 'deg', 0.05, 'y.id, deg')}",
    "seeds_cc": f"{flow(CLUSTER)}, bu AS (SELECT id, {BUCKET} AS bucket FROM cc), {top_share('bu', 'bucket', 0.05, 'y.id, bucket')}",
    "seeds_gd_prob": f"""{sup()}, f AS (SELECT deg AS degree, count(*) AS n FROM g GROUP BY deg), z AS (SELECT sum(n)::DOUBLE AS v FROM f), pr AS (SELECT degree, n, n / v AS p, v FROM f, z)
        SELECT degree, n, round(p, 9) AS p, round(p * 0.05::DOUBLE * v / (SELECT sum(n * p) FROM pr), 9) AS seed_p, round(p + (1 - (SELECT max(p) FROM pr)) / 2, 9) AS spread_p FROM pr""",
    "seeds_rd": f"{sup()} SELECT id, deg FROM g WHERE {u(1, 0, 'seed', 'id')} < 0.05::DOUBLE",
    "lp_label_histogram": f"{sup()} SELECT src AS id, part AS label, count(*) AS n FROM s JOIN l ON l.id = s.dst GROUP BY 1, 2",
    **{f"lp_score_{kind}": f"{sup(TOTALS, COUNTS, scored(kind))} SELECT id, label, round(h, 9) AS score FROM h" for kind in ("edge", "vertex", "baseline")},
    "lp_argmax": f"{sup(FIRST)} SELECT id, cur, nxt FROM x",
    "lp_demand": f"{sup(FIRST, ASKS)} SELECT label, requests, demand FROM d",
    "lp_admission": f"{sup(FIRST, ASKS, CHANCE)} SELECT id, nxt, moved FROM ad",
    "lp_migrate": f"{sup(FIRST, ASKS, CHANCE)} SELECT id, cur, CASE WHEN moved THEN nxt ELSE cur END AS part FROM ad",
    "lp_first_partition": f"WITH {HUB_FIRST} SELECT id, coalesce(cur, -1) AS cur, coalesce(nxt, -1) AS nxt FROM x",
    "lp_first_migration": f"WITH {HUB_FIRST} SELECT id, coalesce(nxt, cur, floor({u(1, 0, 'left', 'id')} * {K})::INT) AS part FROM x",
    "lp_label_histogram_weighted": f"{sup()} SELECT src AS id, part AS label, sum(CASE WHEN is_virtual THEN 1 ELSE 2 END)::BIGINT AS n FROM s JOIN l ON l.id = s.dst GROUP BY 1, 2",
    "partition_edge_cycles": cycles("edge", 2, HUB0),
    "partition_vertex_cycles": cycles("vertex", 2, HUB0),
    "partition_baseline_cycles": cycles("baseline", 3, UNIFORM0, first=False),
    "partition_hybrid_cycles": cycles("baseline", 2, HUB0),
    "partition_weighted_cycles": cycles("edge", 2, UNIFORM0, weight=2, directed=False, first=False),
    "partition_regrow_cycles": cycles("edge", 2, GROW0, k=K + 2, first=False),
    "partition_edge": cycles("edge", 40, HUB0, settle=True),
    "partition_vertex": cycles("vertex", 40, HUB0, settle=True),
    "partition_baseline": cycles("baseline", 40, UNIFORM0, first=False, settle=True),
    "partition_hybrid": cycles("baseline", 40, HUB0, settle=True),
    "partition_sampled": cycles("edge", 40, [*sampled("rd", 50, SUPPLY), SAMPLED0], settle=True),
    "partition_regrow": cycles("edge", 40, GROW0, k=K + 2, first=False, settle=True),
    "partition_report": report({"ALGORITHM": "given"}),
    **{f"sample_{kind}": samples(kind) for kind in ("rd", "hd", "cc", "gd")},
    "deadlock_detection": deadlock(),
    "checkpoint_supersteps": supersteps(),
    "identity": f"WITH {FLOW} SELECT src, dst FROM e",
    "aggregate_overwrite": f"WITH {SUPPLY} SELECT src, arg_max((1 + (src * 31 + dst) % 10)::DOUBLE, dst) AS last_value FROM e GROUP BY src",
    "aggregate_map_merge": f"WITH {SUPPLY}, {VERTS} SELECT d AS key, count(*) AS total FROM (SELECT id, count(e.dst) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY id) GROUP BY d",
    "master_accumulate": "SELECT i::INT AS step, coalesce(sum(j / 2.0 + 1), 0)::DOUBLE AS total FROM range(11) r(i) LEFT JOIN range(11) q(j) ON j < i GROUP BY i",
}
