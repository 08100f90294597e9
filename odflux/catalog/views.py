"""The test inputs as SQL views (see FIXTURES.md)."""

VIEWS = {
    "place": """
        select n.n_name as name, n.n_nationkey as place_key, r.r_name as province, n.n_nationkey % 6 as tier,
               cast((n.n_nationkey * 37) % 100 as double) as mc_x, cast((n.n_nationkey * 53) % 100 as double) as mc_y
        from nation n join region r on n.n_regionkey = r.r_regionkey""",
    "tiers": "select name, tier from place where place_key < 23",
    "location": """select name, mc_x, mc_y, mc_x / 10 as ll_x, -mc_y / 10 as ll_y from place where place_key < 24""",
    "region_city": """
        select case when place_key < 5 then 'R1' when place_key < 12 then 'R2' else 'R3' end as region, name
        from place where place_key < 18""",
    "trip": """
        select o.o_custkey as userid, cast(o.o_orderdate as date) as event_date, pf.province as province_from,
               pf.name as city_from, pt.province as province_to, pt.name as city_to, p.p_type as value
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
        join supplier s on l.l_suppkey = s.s_suppkey join part p on l.l_partkey = p.p_partkey
        join place pf on c.c_nationkey = pf.place_key join place pt on s.s_nationkey = pt.place_key""",
    "daily_flow": """
        select event_date, province_from, city_from, province_to, city_to, count(distinct userid) as cnt
        from trip group by all""",
    "month_flow": """
        select strftime(event_date, '%Y%m') as time, city_from as src, city_to as dst, cast(sum(cnt) as bigint) as cnt
        from daily_flow group by all""",
    "season_flow": """
        select concat(year(event_date), 'Q', quarter(event_date)) as time, city_from as src, city_to as dst,
               cast(sum(cnt) as bigint) as cnt
        from daily_flow group by all""",
    "season_edges": "select * from season_flow where src <> dst",
    "all_flow": """select 'all' as time, src, dst, cast(sum(cnt) as bigint) as cnt from season_flow group by all""",
    "typed_daily": """
        select event_date, value, city_from as src, city_to as dst, count(distinct userid) as cnt from trip group by all""",
    "typed_flow": """
        select concat(year(event_date), 'Q', quarter(event_date)) as time, value, src, dst, cast(sum(cnt) as bigint) as cnt
        from typed_daily group by all""",
    "wage": """
        select cast(year(o.o_orderdate) as integer) as year, n.n_name as name, cast(sum(cast(round(c.c_acctbal * 100) as bigint)) as bigint) / count(*) as wage
        from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
        group by all""",
    "gdp": """
        select n.n_name as name, cast(sum(cast(round(o.o_totalprice * 100) as bigint)) as bigint) / 100000000 as gdp
        from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
        group by all""",
    "demand": """
        select concat(year(l.l_shipdate), 'Q', quarter(l.l_shipdate)) as time, pl.name as name, p.p_type as type,
               count(*) as cnt
        from lineitem l join part p on l.l_partkey = p.p_partkey join supplier s on l.l_suppkey = s.s_suppkey
        join place pl on s.s_nationkey = pl.place_key group by all""",
    "topic_count": """
        select concat(year(o.o_orderdate), 'Q', quarter(o.o_orderdate)) as time, pl.name as name,
               cast(l.l_partkey % 30 as integer) as topic, count(*) as cnt
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
        join place pl on c.c_nationkey = pl.place_key group by all""",
    "post": """
        select d.doc_id, pl.name as city, strftime(date '2019-08-01' + cast(d.doc_id % 1000 as integer), '%Y-%m-%d') as startdate,
               d.text as title
        from documents d join place pl on d.doc_id % 25 = pl.place_key""",
    "annotation": """
        select d.doc_id, d.lang as name, l.quality as label, l.toxic as label2
        from labels l join documents d on l.doc_id = d.doc_id""",
    "log_event": """
        select event_id, cast(user_id as varchar) as userid, ts as event_time, event_type as query,
               props as title, user_id % 100 * 40.0 as x, value * 10 as y
        from events""",
    "grid": """
        select cast(gx * 100000 + gy as bigint) as grid_id, p.province, p.name as city
        from (select distinct cast(floor(cast(trunc(x) as bigint) / 500.0) as bigint) as gx,
                     cast(floor(cast(trunc(y) as bigint) / 500.0) as bigint) as gy from log_event) g
        join place p on (g.gx * 7 + g.gy * 3) % 25 = p.place_key where (g.gx + g.gy) % 5 <> 4""",
    # Dictionary words are the names of parts and the words in them, overlapping on purpose.
    "area": """
        select word, p.province, null as city, null as region, 0 as level, 0.0 as x, 0.0 as y, 0 as original_level
        from (select distinct split_part(p_name, ' ', 1) as word from part) w
        join (select distinct province, place_key from place where place_key < 5) p on length(word) % 5 = p.place_key
        union all
        select word, p.province, p.name, null, 1, p.mc_x, p.mc_y, 1 + k
        from (select distinct split_part(p_name, ' ', 2) as word from part) w
        cross join (values (0), (1)) t(k)
        join place p on (length(word) * 3 + k * 7) % 25 = p.place_key
        union all
        select word, p.province, p.name, word, 2, p.mc_x, p.mc_y, 2
        from (select distinct p_name as word from part) w
        join place p on length(word) % 25 = p.place_key""",
    # A search by each line item: its part is searched for, its supplier's number gives a second one.
    "search": """
        select o.o_custkey as userid, o.o_orderdate as event_time, p1.p_name as query, p2.p_name as title,
               concat(p1.p_name, ';;', p2.p_name) as text, pl.mc_x as x, pl.mc_y as y, pl.province, pl.name as city
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
        join place pl on c.c_nationkey = pl.place_key join part p1 on l.l_partkey = p1.p_partkey
        join part p2 on l.l_suppkey = p2.p_partkey""",
    "token": r"""
        select doc_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)) as word
        from post""",
    "vocabulary": r"""
        select word, count(*) as cnt from token where length(word) >= 2 and not regexp_full_match(word, '[0-9]+')
        group by word having count(*) > 100""",
    "season_label": """
        select time, name, cast(arg_min(place_key % 5, (-cnt, dst)) as integer) as label
        from (select e.time, e.src as name, e.dst, e.cnt, p.place_key
              from season_edges e join place p on e.dst = p.name) group by all""",
}


def hits_views(edges: str, rounds: int, prefix: str, by=("time",)) -> dict[str, str]:
    """HITS of a fixed number of rounds as a chain of views; result ``<prefix>``."""
    keys = ", ".join(by)
    ekeys = ", ".join(f"e.{b}" for b in by)
    using = lambda *cols: ", ".join((*by, *cols))
    views = {
        f"{prefix}_v": f"select {keys}, src as name from {edges} union select {keys}, dst from {edges}",
        f"{prefix}_h0": f"select {keys}, name, 1.0::double as hub from {prefix}_v",
    }
    for r in range(1, rounds + 2):
        views[f"{prefix}_a{r}"] = (
            f"select {ekeys}, e.dst as name, sum(h.hub * e.cnt / 1e4) as authority from {edges} e join {prefix}_h{r - 1} h "
            f"on e.src = h.name and {' and '.join(f'e.{b} = h.{b}' for b in by)} group by {ekeys}, e.dst"
        )
        if r <= rounds:
            views[f"{prefix}_h{r}"] = (
                f"select {ekeys}, e.src as name, sum(a.authority * e.cnt / 1e4) as hub from {edges} e join {prefix}_a{r} a "
                f"on e.dst = a.name and {' and '.join(f'e.{b} = a.{b}' for b in by)} group by {ekeys}, e.src"
            )
    views[prefix] = f"""
        select {', '.join(f'v.{b}' for b in by)}, v.name,
               coalesce(h.hub / sum(h.hub) over (partition by {', '.join(f'v.{b}' for b in by)}), 0) as hub,
               coalesce(a.authority / sum(a.authority) over (partition by {', '.join(f'v.{b}' for b in by)}), 0) as authority
        from {prefix}_v v left join {prefix}_h{rounds} h using ({using('name')})
        left join {prefix}_a{rounds + 1} a using ({using('name')})"""
    return views


def pagerank_views(edges: str, rounds: int, prefix: str, by=("time",), turn: bool = False) -> dict[str, str]:
    """PageRank of a fixed number of rounds as a chain of views; result ``<prefix>``."""
    keys = ", ".join(by)
    src, dst = ("dst", "src") if turn else ("src", "dst")
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in by)
    akeys = lambda a: ", ".join(f"{a}.{k}" for k in by)
    views = {
        f"{prefix}_w": f"select {keys}, {src} as src, {dst} as dst, cnt / sum(cnt) over (partition by {keys}, {src}) as w from {edges}",
        f"{prefix}_n": f"""select *, count(*) over (partition by {keys}) as n from
            (select {keys}, src as name from {edges} union select {keys}, dst from {edges})""",
        f"{prefix}_r0": f"select {keys}, name, n, 1.0 / n as pr from {prefix}_n",
    }
    for r in range(1, rounds + 1):
        old = f"{prefix}_r{r - 1}"
        views[f"{prefix}_r{r}"] = f"""
            select {akeys('v')}, v.name, v.n, 0.15 / v.n + 0.85 * (coalesce(i.s, 0) + coalesce(d.s, 0) / v.n) as pr
            from {prefix}_n v
            left join (select {akeys('w')}, w.dst, sum(w.w * o.pr) as s from {prefix}_w w join {old} o
                       on w.src = o.name and {on('w', 'o')} group by {akeys('w')}, w.dst) i
              on v.name = i.dst and {on('v', 'i')}
            left join (select {akeys('o')}, sum(o.pr) as s from {old} o where not exists
                       (select 1 from {prefix}_w w where w.src = o.name and {on('w', 'o')}) group by {akeys('o')}) d
              on {on('v', 'd')}"""
    views[prefix] = f"select {keys}, name, pr from {prefix}_r{rounds}"
    return views


SCORE_ROUNDS = 3
VIEWS.update(hits_views("located_edges", SCORE_ROUNDS, "hits_season"))
VIEWS.update(
    {
        "located_edges": "select e.* from season_edges e semi join location a on e.src = a.name semi join location b on e.dst = b.name",
        "season_degree": """
            select time, name, cast(sum(i) as bigint) as flow_in, cast(sum(o) as bigint) as flow_out
            from (select time, dst as name, cnt as i, 0 as o from located_edges
                  union all select time, src, 0, cnt from located_edges) group by all""",
        "season_gross": """
            select time, src as name, sum(case when src <> dst then cnt else 0 end) / sum(cnt) as gross_flow
            from season_flow group by all""",
        "season_net": """
            select time, name, (sum(i) - sum(o)) * 1000 / any_value(total) as flow_in_net_country_norm
            from (select time, dst as name, cnt as i, 0 as o from season_flow
                  union all select time, src, 0, cnt from season_flow)
            join (select time, sum(cnt) as total from season_flow group by all) using (time) group by time, name""",
        # Scores per quarter and place that the analyses start from.
        "score": """
            select time, name, coalesce(flow_in, 0) as flow_in, coalesce(flow_out, 0) as flow_out,
                   coalesce(flow_in - flow_out, 0) as flow_in_net, coalesce(hub, 0) as hub,
                   coalesce(authority, 0) as authority, coalesce(gross_flow, 0) as gross_flow,
                   coalesce(flow_in_net_country_norm, 0) as flow_in_net_country_norm
            from (season_degree full join hits_season using (time, name))
            full join (season_gross join season_net using (time, name)) using (time, name)""",
    }
)
