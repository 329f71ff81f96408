"""SQL twins of the registered queries, over the driver's tables."""

from __future__ import annotations

# Common table expressions, by name; each may use those before it.
_CTES = {
    "base": """
base AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type,
  CAST(round(value * 100) AS BIGINT) AS amount,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "ev": """
ev AS (SELECT 'main' AS log_id, event_id AS seq,
  CASE WHEN (us // 3600000000 - 473352 + 1) % 5 = 0 THEN 0
       ELSE us // 3600000000 - 473352 + 1 END AS combat_id,
  ts, us,
  CASE event_type WHEN 'click' THEN 'SPELL_DAMAGE' WHEN 'purchase' THEN 'SPELL_PERIODIC_DAMAGE'
    WHEN 'view' THEN 'SPELL_HEAL' WHEN 'signup' THEN 'SPELL_ABSORBED' ELSE 'UNIT_DIED' END AS event,
  CASE WHEN user_id % 2 = 0 THEN 'P' || (user_id % 7) || '-Realm-EU' ELSE 'npc' || (user_id % 5) END AS source,
  CASE WHEN k % 23 = 0 THEN '' WHEN k % 11 = 0 THEN 'P' || (user_id % 7) || '-Realm-EU'
    ELSE 'T' || (k % 9) END AS target,
  'S' || (k % 17) AS spell_name, amount,
  CASE WHEN event_type = 'view' THEN amount - amount % 3 ELSE amount END AS effective_amount,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'damage' WHEN event_type = 'view' THEN 'heal'
    WHEN event_type = 'signup' THEN 'absorb' ELSE 'other' END AS type,
  CAST(day(ts) % 4 AS BIGINT) AS zone_id,
  CASE WHEN day(ts) % 4 = 0 THEN '' ELSE 'Zone' || (day(ts) % 4) END AS zone_name,
  k AS spell_id FROM base)""",
    "fights": """
fights AS (SELECT * FROM ev WHERE combat_id > 0)""",
    "enc": """
enc AS (SELECT log_id, combat_id, min(us) AS start_us, max(us) AS end_us,
  (max(us) - min(us)) / 1e6 AS dur, max(us) - min(us) AS span_us,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS heal
  FROM fights GROUP BY ALL)""",
    "player": """
player AS (SELECT log_id, combat_id, source AS player FROM (
  SELECT log_id, combat_id, source, row_number() OVER (PARTITION BY log_id, combat_id
    ORDER BY count(*) DESC, source) AS r
  FROM ev GROUP BY log_id, combat_id, source) WHERE r = 1)""",
    "known": """
known AS (SELECT * FROM fights WHERE zone_name <> '' AND zone_name <> 'UNKNOWN AREA')""",
    "hits_target": """
hits_target AS (SELECT log_id, combat_id, target AS main_target FROM (
  SELECT log_id, combat_id, target, row_number() OVER (PARTITION BY log_id, combat_id
    ORDER BY count(*) DESC, target) AS r
  FROM known WHERE type = 'damage' AND target <> '' AND target <> (
    SELECT source FROM known GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
  GROUP BY log_id, combat_id, target) WHERE r = 1)""",
    "summary": """
summary AS (SELECT k.log_id, k.combat_id, min(us) AS start_us, max(us) AS end_us,
  (max(us) - min(us)) / 1e6 AS dur, max(us) - min(us) AS span_us,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS heal,
  max(zone_name) AS zone_name, max(zone_id) AS zone_id, any_value(main_target) AS main_target
  FROM known k LEFT JOIN hits_target t USING (log_id, combat_id) GROUP BY k.log_id, k.combat_id)""",
    "enc_runs": """
enc_runs AS (SELECT * EXCLUDE (is_new), CAST(sum(is_new) OVER (PARTITION BY log_id ORDER BY start_us, combat_id) AS BIGINT) AS run_id
  FROM (SELECT *, CASE WHEN lag(end_us) OVER w IS NULL OR lag(zone_name) OVER w <> zone_name
      OR start_us - lag(end_us) OVER w > 1200000000 THEN 1 ELSE 0 END AS is_new
    FROM summary WINDOW w AS (PARTITION BY log_id ORDER BY start_us, combat_id)))""",
    "kills": """
kills AS (SELECT log_id, combat_id AS seq, 'Boss' || (combat_id % 5) AS boss_name, min(us) AS start_us,
  max(us) + combat_id % 30 * 1000000 AS end_us, CASE WHEN combat_id % 21 = 0 THEN 0 ELSE 1 END AS kill_flag,
  CASE WHEN combat_id % 4 = 1 THEN 0 ELSE max(zone_id) END AS zone_id
  FROM fights WHERE combat_id % 7 = 0 GROUP BY log_id, combat_id)""",
    "roles": """
roles AS (SELECT r.log_id, r.run_id, CASE WHEN any_value(spec) IS NULL THEN 'DPS' ELSE 'Healer' END AS run_role,
  any_value(spec) IS NOT NULL AS is_healer_run, coalesce(any_value(spec), '') AS run_spec,
  CASE any_value(spec) WHEN 'Holy_Priest' THEN 'Priest' WHEN 'Discipline_Priest' THEN 'Priest'
    WHEN 'Mistweaver' THEN 'Monk' WHEN 'Restoration_Druid' THEN 'Druid' ELSE '' END AS run_class
  FROM (SELECT DISTINCT log_id, run_id FROM enc_runs) r LEFT JOIN (
    SELECT log_id, run_id, spec FROM (
      SELECT e.log_id, run_id, CASE WHEN spell_id > 0 AND spell_id % 29 = 0
          THEN ['Holy_Priest', 'Mistweaver', 'Restoration_Druid'][(spell_id // 29) % 3 + 1]
          ELSE 'Discipline_Priest' END AS spec,
        row_number() OVER (PARTITION BY e.log_id, run_id ORDER BY us, seq) AS r
      FROM known e JOIN enc_runs USING (log_id, combat_id)
      WHERE (spell_id > 0 AND spell_id % 29 = 0) OR spell_name = 'S16') WHERE r = 1) s USING (log_id, run_id)
  GROUP BY r.log_id, r.run_id)""",
    "run_sums": """
run_sums AS (SELECT log_id, run_id, arg_min(zone_name, start_us) AS zone_name,
  arg_min(zone_id, start_us) AS zone_id, min(start_us) AS start_us, max(end_us) AS end_us,
  count(*) AS n_encounters, CAST(sum(dmg) AS BIGINT) AS dmg, CAST(sum(heal) AS BIGINT) AS heal,
  CAST(sum(span_us) AS BIGINT) / 1e6 AS dur FROM enc_runs GROUP BY ALL)""",
    "run_kills": """
run_kills AS (SELECT log_id, run_id, string_agg(boss_name, ', ' ORDER BY seq) AS boss_names FROM (
  SELECT k.log_id, k.seq, k.boss_name, min(run_id) AS run_id FROM kills k JOIN run_sums r
    ON k.log_id = r.log_id AND k.zone_id = r.zone_id AND k.kill_flag = 1
    AND k.end_us BETWEEN r.start_us AND r.end_us + 600000000
  GROUP BY ALL) GROUP BY ALL)""",
    "run_rows": """
run_rows AS (SELECT s.*, CASE WHEN dur > 0 THEN dmg / dur ELSE 0.0 END AS avg_dps,
  CASE WHEN dur > 0 THEN heal / dur ELSE 0.0 END AS avg_hps,
  boss_names IS NOT NULL AS has_boss_kill, coalesce(boss_names, '') AS boss_names,
  run_role, is_healer_run, run_spec, run_class
  FROM run_sums s LEFT JOIN run_kills USING (log_id, run_id) JOIN roles USING (log_id, run_id))""",
    "boss": """
boss AS (SELECT m.boss_name, m.log_id, m.combat_id, player AS character, split_part(player, '-', 1) AS character_short,
  start_us, end_us, dur AS duration_s, dmg AS total_damage, heal AS total_heal,
  CASE WHEN dur > 0 THEN dmg / dur ELSE 0.0 END AS dps, CASE WHEN dur > 0 THEN heal / dur ELSE 0.0 END AS hps,
  run_role, run_spec
  FROM (SELECT *, row_number() OVER (PARTITION BY log_id, combat_id ORDER BY kill_seq) AS r2 FROM (
    SELECT e.*, k.seq AS kill_seq, k.boss_name, row_number() OVER (PARTITION BY k.log_id, k.seq
      ORDER BY e.start_us, e.combat_id) AS r
    FROM enc_runs e JOIN kills k ON e.log_id = k.log_id AND k.kill_flag = 1
      AND abs(e.end_us - k.end_us) <= 20000000
      AND (e.zone_id = k.zone_id OR e.zone_id = 0 OR k.zone_id = 0)) WHERE r = 1) m
  JOIN player USING (log_id, combat_id) JOIN roles USING (log_id, run_id) WHERE r2 = 1)""",
    "buckets": """
buckets AS (SELECT log_id, combat_id, us // 5000000 * 5000000 AS bucket,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dps,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS hps,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage' AND spell_name = 'S3'), 0) AS BIGINT) AS sel_d,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb') AND spell_name = 'S3'), 0) AS BIGINT) AS sel_h,
  bool_or(type = 'damage') AS has_d, bool_or(type IN ('heal', 'absorb')) AS has_h
  FROM fights WHERE type IN ('damage', 'heal', 'absorb') GROUP BY ALL)""",
    "spine": """
spine AS (SELECT log_id, combat_id, unnest(range(lo, hi + 1, 5000000)) AS bucket
    FROM (SELECT log_id, combat_id, min(bucket) AS lo, max(bucket) AS hi FROM buckets WHERE has_d GROUP BY ALL)
  UNION SELECT log_id, combat_id, unnest(range(lo, hi + 1, 5000000)) AS bucket
    FROM (SELECT log_id, combat_id, min(bucket) AS lo, max(bucket) AS hi FROM buckets WHERE has_h GROUP BY ALL))""",
    "series": """
series AS (SELECT log_id, combat_id, bucket, coalesce(dps, 0) AS dps, coalesce(hps, 0) AS hps,
  coalesce(sel_d, 0) AS sel_d, coalesce(sel_h, 0) AS sel_h
  FROM spine LEFT JOIN buckets USING (log_id, combat_id, bucket))""",
    "per_source": """
per_source AS (SELECT source, log_id, combat_id, (max(us) - min(us)) / 1e6 AS dur, max(us) - min(us) AS span_us,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS heal
  FROM fights GROUP BY ALL)""",
    "prints": """
prints AS (SELECT * FROM (SELECT source AS character, log_id, combat_id,
  coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (target <> '' AND target <> source), '') AS targets,
  row_number() OVER (PARTITION BY source ORDER BY combat_id DESC) AS r
  FROM fights GROUP BY source, log_id, combat_id))""",
    "timeline": """
timeline AS (SELECT * FROM ev WHERE type IN ('damage', 'heal', 'absorb'))""",
    "ranks": """
ranks AS (SELECT log_id, combat_id, spell_name, count(*) AS uses, row_number() OVER (
    PARTITION BY log_id, combat_id ORDER BY count(*) DESC, spell_name) AS spell_rank
  FROM timeline GROUP BY log_id, combat_id, spell_name)""",
    "starts": """
starts AS (SELECT log_id, combat_id, min(us) AS start_us, max(us) - min(us) AS span_us FROM ev GROUP BY ALL)""",
    "lines": """
lines AS (SELECT 'log' || (user_id % 3) AS log_id, event_id AS seq,
  1704067200000000 + (us - 1704067200000000) // 100 AS us, user_id, event_type, k, amount,
  CASE WHEN user_id % 5 = 0 THEN 1298 ELSE 1297 END AS own_flags,
  'Player-1-' || (user_id % 7) AS pguid, 'P' || (user_id % 7) || '-Realm-EU' AS pname,
  'Creature-0-' || (event_id // 60) || '-' || (k % 5) AS eguid, 'T' || (k % 9) || ', the Odd' AS ename
  FROM base)""",
    "parsed": """
parsed AS (SELECT log_id, seq, us, CASE event_type WHEN 'click' THEN 'SPELL_DAMAGE' WHEN 'purchase' THEN 'SWING_DAMAGE'
    WHEN 'view' THEN 'SPELL_HEAL' ELSE 'SPELL_ABSORBED' END AS event, pname AS source,
  CASE WHEN event_type IN ('view', 'signup') THEN pname ELSE ename END AS target,
  CASE WHEN event_type = 'purchase' THEN 'Melee' WHEN event_type = 'signup' THEN 'Ward, S' || (k % 17)
    ELSE 'S' || (k % 17) END AS spell_name, amount,
  CASE WHEN event_type = 'view' THEN amount - amount % 3 ELSE amount END AS effective_amount,
  CASE WHEN event_type = 'view' THEN 'heal' WHEN event_type = 'signup' THEN 'absorb' ELSE 'damage' END AS type,
  CASE WHEN event_type IN ('click', 'view') THEN k ELSE 0 END AS spell_id
  FROM lines WHERE own_flags = 1297 AND event_type <> 'error' AND (event_type <> 'purchase' OR k % 2 = 0))""",
    "day_enc": """
day_enc AS (SELECT CAST(ts AS DATE) AS day, log_id, combat_id, max(us) - min(us) AS span_us,
  CAST(sum(effective_amount) FILTER (type = 'damage') AS BIGINT)
    / greatest((max(us) - min(us)) / 1e6, 1.0) AS dps FROM fights GROUP BY ALL)""",
    "enc_rows": """
enc_rows AS (SELECT e.log_id, run_id, e.combat_id, coalesce(main_target, '—') AS target,
  strftime(make_timestamp(start_us), '%H:%M:%S') AS start,
  format('{}:{:02d}', CAST(floor(dur) AS BIGINT) // 60, CAST(floor(dur) AS BIGINT) % 60) AS duration,
  dmg AS damage, heal AS healing, coalesce(absorb, 0) AS absorb,
  round_even(CASE WHEN dur > 0 THEN dmg / dur ELSE 0.0 END, 1) AS dps,
  round_even(CASE WHEN dur > 0 THEN heal / dur ELSE 0.0 END, 1) AS hps,
  EXISTS (SELECT 1 FROM kills k WHERE k.log_id = e.log_id AND k.kill_flag = 1
    AND abs(k.end_us - e.end_us) < 20000000) AS is_boss
  FROM enc_runs e LEFT JOIN (SELECT log_id, combat_id, CAST(sum(effective_amount) AS BIGINT) AS absorb
    FROM ev WHERE type = 'absorb' GROUP BY ALL) USING (log_id, combat_id))""",
    "run_ev": """
run_ev AS (SELECT e.*, run_id FROM ev e JOIN enc_runs r USING (log_id, combat_id))""",
    "trend": """
trend AS (SELECT log_id, combat_id, dps, hps,
  CASE w WHEN 2 THEN avg(dps) OVER w2 WHEN 3 THEN avg(dps) OVER w3 WHEN 4 THEN avg(dps) OVER w4 ELSE avg(dps) OVER w5 END AS dps_roll,
  CASE w WHEN 2 THEN avg(hps) OVER w2 WHEN 3 THEN avg(hps) OVER w3 WHEN 4 THEN avg(hps) OVER w4 ELSE avg(hps) OVER w5 END AS hps_roll
  FROM (SELECT log_id, combat_id, CASE WHEN dur > 0 THEN dmg / dur ELSE 0.0 END AS dps,
    CASE WHEN dur > 0 THEN heal / dur ELSE 0.0 END AS hps,
    greatest(2, least(5, count(*) OVER (PARTITION BY log_id) // 3)) AS w FROM enc )
  WINDOW w2 AS (PARTITION BY log_id ORDER BY combat_id ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING),
    w3 AS (PARTITION BY log_id ORDER BY combat_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
    w4 AS (PARTITION BY log_id ORDER BY combat_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),
    w5 AS (PARTITION BY log_id ORDER BY combat_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""",
    "nth": """
nth AS (SELECT *, row_number() OVER (PARTITION BY character, targets ORDER BY combat_id) AS n FROM prints
  WHERE character IN ('P0-Realm-EU', 'P2-Realm-EU') AND targets <> '')""",
    "pairs": """
pairs AS (SELECT r.combat_id AS ref_combat_id, c.character, c.log_id, c.combat_id,
  array_to_string(list_slice(string_split(c.targets, ','), 1, 4), ', ')
    || CASE WHEN len(string_split(c.targets, ',')) > 4 THEN ' +' || (len(string_split(c.targets, ',')) - 4) ELSE '' END AS label
  FROM nth c JOIN nth r ON c.targets = r.targets AND c.n = r.n AND r.character = (
    SELECT character FROM prints WHERE character IN ('P0-Realm-EU', 'P2-Realm-EU') GROUP BY character ORDER BY count(*), character LIMIT 1)
  WHERE (SELECT count(*) FROM nth x WHERE x.targets = c.targets AND x.n = c.n) = 2)""",
    "sizes": """
sizes AS (SELECT character, count(*) AS n FROM prints GROUP BY character)""",
    "every_nth": """
every_nth AS (SELECT *, row_number() OVER (PARTITION BY character, targets ORDER BY combat_id) AS n FROM prints
  WHERE targets <> '')""",
    "every_pairs": """
every_pairs AS (SELECT comparison, ref_combat_id, unnest([a, b]) AS character, 'main' AS log_id, unnest([a_id, b_id]) AS combat_id, label FROM (
  SELECT '["' || x.character || '","' || y.character || '"]' AS comparison, x.character AS a, y.character AS b,
    x.combat_id AS a_id, y.combat_id AS b_id,
    CASE WHEN p.n <= q.n THEN x.combat_id ELSE y.combat_id END AS ref_combat_id,
    array_to_string(list_slice(string_split(x.targets, ','), 1, 4), ', ')
      || CASE WHEN len(string_split(x.targets, ',')) > 4 THEN ' +' || (len(string_split(x.targets, ',')) - 4) ELSE '' END AS label
  FROM every_nth x JOIN every_nth y ON x.targets = y.targets AND x.n = y.n AND x.character < y.character
    JOIN sizes p ON p.character = x.character JOIN sizes q ON q.character = y.character))""",
    "places": """
places AS (SELECT spell_name, row_number() OVER (ORDER BY place, spell_name) AS position FROM (
  SELECT spell_name, min(CASE WHEN combat_id = (SELECT max(combat_id) FROM ev ) THEN 0 ELSE 1000000 END + spell_rank) AS place
  FROM ranks WHERE combat_id IN ((SELECT max(combat_id) FROM ev ), (SELECT min(combat_id) FROM fights )) GROUP BY spell_name))""",
    "raw": """
raw AS (SELECT log_id, seq, us,
  CASE event_type WHEN 'click' THEN 'SPELL_DAMAGE' WHEN 'purchase' THEN 'SWING_DAMAGE' WHEN 'view' THEN 'SPELL_HEAL'
    WHEN 'signup' THEN 'SPELL_ABSORBED' ELSE 'UNIT_DIED' END AS event,
  CASE WHEN event_type = 'error' THEN '0000000000000000' WHEN by_enemy THEN eguid ELSE pguid END AS src_guid,
  CASE WHEN event_type = 'error' THEN 'nil' WHEN by_enemy THEN ename ELSE pname END AS src_name,
  CASE WHEN event_type = 'error' THEN 2147483648 WHEN by_enemy THEN 68168 ELSE own_flags END AS src_flags,
  CASE WHEN to_player THEN pguid ELSE eguid END AS dst_guid,
  CASE WHEN to_player THEN pname ELSE ename END AS dst_name,
  CASE WHEN to_player THEN own_flags ELSE 68168 END AS dst_flags
  FROM (SELECT *, event_type = 'signup' OR (event_type = 'purchase' AND k % 2 = 1) AS by_enemy,
    event_type IN ('view', 'signup') OR (event_type = 'purchase' AND k % 2 = 1)
      OR (event_type = 'error' AND k % 10 = 3) AS to_player FROM lines )
  WHERE event_type <> 'error' OR k % 10 NOT IN (0, 1, 2, 4))""",
    "markers": """
markers AS (SELECT log_id, seq, us, CASE k % 10 WHEN 1 THEN 'START' ELSE 'END' END AS marker, 'Boss' || (user_id % 5) AS boss_name,
  user_id % 4 AS zone, user_id % 2 AS flag FROM lines WHERE event_type = 'error' AND k % 10 IN (1, 2))""",
    "located": """
located AS (SELECT *, CASE event_type WHEN 'view' THEN CAST(amount AS DOUBLE) ELSE CAST(100 + k AS DOUBLE) END AS x,
  CASE event_type WHEN 'view' THEN CAST(amount AS DOUBLE) ELSE CAST(-200 - user_id % 50 AS DOUBLE) END AS y
  FROM lines WHERE event_type = 'click' OR (event_type = 'view' AND amount > 10))""",
    "oev": """
oev AS (SELECT 'orders' AS log_id, l_orderkey + 1 AS combat_id, epoch_us(o_orderdate) + l_linenumber * 1000000 AS us,
  'S' || l_suppkey AS source, 'P' || l_partkey AS target, 'F' || l_linestatus || l_linenumber AS spell_name,
  CAST(round(l_extendedprice * 100 * (1 - l_discount)) AS BIGINT) AS effective_amount,
  CASE l_returnflag WHEN 'A' THEN 'absorb' WHEN 'R' THEN 'heal' ELSE 'damage' END AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "oenc": """
oenc AS (SELECT log_id, combat_id, min(us) AS start_us, max(us) AS end_us, (max(us) - min(us)) / 1e6 AS dur,
  max(us) - min(us) AS span_us,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS heal
  FROM oev GROUP BY ALL)""",
    "hostile": """
hostile AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS rn FROM (
  SELECT log_id, seq, us, event = 'UNIT_DIED' AS death, dst_guid LIKE 'Player%' AND event = 'UNIT_DIED' AS is_player,
    CASE WHEN event <> 'UNIT_DIED' AND src_flags = 68168 THEN src_guid ELSE dst_guid END AS guid,
    min(CASE WHEN event = 'UNIT_DIED' THEN seq END) OVER (PARTITION BY log_id,
      CASE WHEN event <> 'UNIT_DIED' AND src_flags = 68168 THEN src_guid ELSE dst_guid END) AS died_seq
  FROM raw WHERE event <> 'SPELL_HEAL') WHERE death OR died_seq IS NULL OR seq < died_seq)""",
    "fight_steps": """
fight_steps AS (
  SELECT DISTINCT log_id, 0 AS rn, CAST(NULL AS BIGINT) AS open_seq, CAST(0 AS BIGINT) AS start_us, CAST(0 AS BIGINT) AS last_us,
    CAST([] AS VARCHAR[]) AS alive, CAST([] AS VARCHAR[]) AS seen,
    CAST(NULL AS STRUCT(o BIGINT, s BIGINT, e BIGINT, g VARCHAR[], r VARCHAR)) AS quiet,
    CAST(NULL AS STRUCT(o BIGINT, s BIGINT, e BIGINT, g VARCHAR[], r VARCHAR)) AS ended FROM hostile
  UNION ALL
  SELECT log_id, rn, CASE WHEN over_reason IS NULL THEN o2 END, s2, CASE WHEN hit OR felled THEN us ELSE last_us END,
    CASE WHEN over_reason IS NULL THEN a2 ELSE [] END, CASE WHEN over_reason IS NULL THEN g2 ELSE [] END, quiet,
    CASE WHEN over_reason IS NOT NULL THEN {'o': o2, 's': s2, 'e': us, 'g': g2, 'r': over_reason} END
  FROM (SELECT *, CASE WHEN felled AND len(a2) = 0 THEN 'all_dead' WHEN is_player AND NOT felled AND o2 IS NOT NULL THEN 'player_death' END AS over_reason
    FROM (SELECT *, NOT death AS hit, CASE WHEN NOT death AND o1 IS NULL THEN seq ELSE o1 END AS o2,
        CASE WHEN NOT death AND o1 IS NULL THEN us ELSE start_us END AS s2,
        death AND list_contains(a1, guid) AS felled,
        CASE WHEN death THEN list_filter(a1, lambda x: x <> guid) WHEN list_contains(a1, guid) THEN a1 ELSE list_append(a1, guid) END AS a2,
        CASE WHEN death OR list_contains(g1, guid) THEN g1 ELSE list_append(g1, guid) END AS g2
      FROM (SELECT h.log_id, h.rn, h.seq, h.us, h.guid, h.death, h.is_player, f.start_us, f.last_us,
          CASE WHEN h.us - f.last_us > 8000000 THEN NULL ELSE f.open_seq END AS o1,
          CASE WHEN h.us - f.last_us > 8000000 THEN [] ELSE f.alive END AS a1,
          CASE WHEN h.us - f.last_us > 8000000 THEN [] ELSE f.seen END AS g1,
          CASE WHEN h.us - f.last_us > 8000000 AND f.open_seq IS NOT NULL
            THEN {'o': f.open_seq, 's': f.start_us, 'e': f.last_us, 'g': f.seen, 'r': 'timeout'} END AS quiet
        FROM fight_steps f JOIN hostile h ON h.log_id = f.log_id AND h.rn = f.rn + 1))))""",
    "fought": """
fought AS (SELECT log_id, c.o AS open_seq, c.s AS start_us, c.e AS end_us, list_sort(c.g) AS guids, c.r AS reason,
  row_number() OVER (PARTITION BY log_id ORDER BY c.o) AS combat_id, count(*) OVER (PARTITION BY log_id) AS n FROM (
    SELECT log_id, quiet AS c FROM fight_steps WHERE quiet IS NOT NULL
    UNION ALL SELECT log_id, ended FROM fight_steps WHERE ended IS NOT NULL
    UNION ALL SELECT log_id, {'o': open_seq, 's': start_us, 'e': last_us, 'g': seen, 'r': 'timeout'} FROM (
      SELECT *, max(rn) OVER (PARTITION BY log_id) AS final FROM fight_steps ) WHERE rn = final AND open_seq IS NOT NULL))""",
    "zoned": """
zoned AS (SELECT f.*, coalesce(z.zone_id, 0) AS zone_id, coalesce(z.zone_name, '') AS zone_name FROM fought f ASOF LEFT JOIN (
  SELECT log_id, seq, user_id % 4 AS zone_id, 'Zone' || (user_id % 4) AS zone_name FROM lines
  WHERE event_type = 'error' AND k % 10 = 0 AND k % 20 <> 0) z ON f.log_id = z.log_id AND f.open_seq >= z.seq)""",
    "refs": """
refs AS (SELECT *, row_number() OVER (ORDER BY combat_id) AS i FROM prints
  WHERE targets <> '' AND character = (SELECT character FROM prints
    WHERE character IN ('P0-Realm-EU', 'P2-Realm-EU') GROUP BY character ORDER BY count(*), character LIMIT 1))""",
    "alike": """
alike AS (SELECT r.i, r.combat_id AS ref_id, r.character AS ref_character, o.character, o.combat_id, r.targets,
    len(list_intersect(string_split(r.targets, ','), string_split(o.targets, ',')))
      / len(list_distinct(list_concat(string_split(r.targets, ','), string_split(o.targets, ',')))) AS similarity
  FROM refs r JOIN prints o ON o.character IN ('P0-Realm-EU', 'P2-Realm-EU') AND o.character <> r.character AND o.targets <> '')""",
    "pair_steps": """
pair_steps AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS picked
  UNION ALL
  SELECT i, CASE WHEN similarity >= 0.5 THEN list_append(used, best) ELSE used END, CASE WHEN similarity >= 0.5 THEN best END
  FROM (SELECT s.i + 1 AS i, any_value(s.used) AS used,
      first(a.combat_id ORDER BY a.similarity DESC, a.combat_id) AS best, max(a.similarity) AS similarity
    FROM pair_steps s LEFT JOIN alike a ON a.i = s.i + 1 AND NOT list_contains(s.used, a.combat_id)
    WHERE s.i < (SELECT max(i) FROM refs ) GROUP BY s.i))""",
}


def _sql(body: str) -> str:
    """Prepend the table expressions the body uses, directly or through others."""
    used, text = [], body
    for name in reversed(_CTES):
        if any(f" {name}{end}" in text for end in (" ", "\n", ")", ",", ";")) or text.endswith(f" {name}"):
            used.append(name)
            text += _CTES[name]
    ctes = ",".join(_CTES[n] for n in reversed(used))
    recursive = "RECURSIVE " if {"fight_steps", "pair_steps"} & set(used) else ""
    return f"WITH {recursive}{ctes}\n{body}" if used else body


def _rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0 END"


def _spells(where: str, by: str = "", top: int | None = None, kind: bool = False, source: str = "ev") -> str:
    """Ability table over rows of ``source`` that meet ``where``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    kinds = "first(type ORDER BY t DESC, type) AS kind," if kind else ""
    body = f"""SELECT {keys}spell, {"kind," if kind else ""} "count", total, total / "count" AS "avg", total / whole * 100 AS pct
FROM (SELECT *, CAST(sum(total) OVER ({part}) AS BIGINT) AS whole,
    row_number() OVER ({part} ORDER BY total DESC, spell) AS r
  FROM (SELECT {keys}spell, {kinds} CAST(sum(c) AS BIGINT) AS "count", CAST(sum(t) AS BIGINT) AS total FROM (
    SELECT {keys}spell_name AS spell, type, count(*) AS c, CAST(sum(effective_amount) AS BIGINT) AS t
    FROM {source} WHERE {where} GROUP BY ALL) GROUP BY {keys}spell))"""
    return body + (f" WHERE r <= {top}" if top else "")


_HEAL = "type IN ('heal', 'absorb')"
_CHARS = "('P0-Realm-EU', 'P2-Realm-EU', 'P4-Realm-EU')"
_LATEST = "(SELECT max(combat_id) FROM ev)"
_OLDEST = "(SELECT min(combat_id) FROM fights)"

# name: (body, columns to round)
_BODIES: dict[str, tuple[str, str]] = {
    "encounter_stats": (
        f"""SELECT log_id, combat_id, start_us AS start_ts, end_us AS end_ts, dmg AS total_damage, heal AS total_heal,
  dur AS duration_s, {_rate('dmg', 'dur')} AS dps, {_rate('heal', 'dur')} AS hps FROM enc """,
        "duration_s dps hps",
    ),
    "overall_stats": (
        f"""SELECT n_encounters, total_duration_s, total_damage, total_heal, best_dps,
  {_rate('total_damage', 'total_duration_s')} AS avg_dps, {_rate('total_heal', 'total_duration_s')} AS avg_hps
FROM (SELECT count(*) AS n_encounters, CAST(sum(span_us) AS BIGINT) / 1e6 AS total_duration_s,
  CAST(sum(dmg) AS BIGINT) AS total_damage, CAST(sum(heal) AS BIGINT) AS total_heal,
  max({_rate('dmg', 'dur')}) AS best_dps FROM enc )""",
        "total_duration_s best_dps avg_dps avg_hps",
    ),
    "character_headline": (
        f"""SELECT source, n_encounters, total_duration_s, total_damage, total_heal, best_dps,
  {_rate('total_damage', 'total_duration_s')} AS avg_dps, {_rate('total_heal', 'total_duration_s')} AS avg_hps,
  split_part(source, '-', 1) AS character
FROM (SELECT source, count(*) AS n_encounters, CAST(sum(span_us) AS BIGINT) / 1e6 AS total_duration_s,
  CAST(sum(dmg) AS BIGINT) AS total_damage, CAST(sum(heal) AS BIGINT) AS total_heal,
  max({_rate('dmg', 'dur')}) AS best_dps FROM per_source GROUP BY source)""",
        "total_duration_s best_dps avg_dps avg_hps",
    ),
    "totals_meta": (
        """SELECT count(*) AS total_combats, CAST(sum(span_us) AS BIGINT) / 1e6 AS total_duration_s,
  (SELECT count(DISTINCT target) FROM ev WHERE target <> '') AS unique_targets FROM starts """,
        "total_duration_s",
    ),
    "top_targets": (
        """SELECT * FROM (SELECT target, CAST(sum(d) AS BIGINT) AS total_damage, count(*) AS encounters, max(enc_dps) AS best_dps,
  min(enc_dps) AS worst_dps, avg(enc_dps) AS avg_dps, CAST(sum(d) AS BIGINT) / count(*) AS avg_damage
FROM (SELECT target, d, CASE WHEN dur > 0 THEN d / dur ELSE 0.0 END AS enc_dps FROM (
    SELECT log_id, combat_id, target, CAST(sum(effective_amount) AS BIGINT) AS d FROM fights
    WHERE type = 'damage' AND target <> '' AND target <> (
      SELECT source FROM fights GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) GROUP BY ALL)
  JOIN enc USING (log_id, combat_id)) GROUP BY target) ORDER BY total_damage DESC, target LIMIT 10""",
        "best_dps worst_dps avg_dps avg_damage",
    ),
    "character_counts": (
        """SELECT source, count(DISTINCT combat_id) AS combats FROM ev WHERE source <> '' GROUP BY source""",
        "",
    ),
    "source_options": (
        """SELECT source, is_player, combats FROM (SELECT source, count(DISTINCT combat_id) AS combats,
  len(string_split(source, '-')) = 3 AND NOT list_contains(string_split(source, '-'), '') AS is_player
  FROM ev GROUP BY source) WHERE is_player OR combats >= 3""",
        "",
    ),
    "combat_headline": (
        f"""SELECT log_id, combat_id, player, dmg AS total_damage, raw AS raw_damage, heal AS total_heal, absorb AS total_absorb,
  dur AS duration_s, {_rate('dmg', 'dur')} AS dps, {_rate('(heal + absorb)', 'dur')} AS hps,
  (kill_us - start_us) / 1e6 AS first_kill_s, CASE WHEN raw > 0 THEN (raw - dmg) / raw * 100 END AS overkill_pct
FROM (SELECT e.log_id, e.combat_id, player, min(us) AS start_us, (max(us) - min(us)) / 1e6 AS dur,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS BIGINT) AS dmg,
  CAST(coalesce(sum(amount) FILTER (type = 'damage'), 0) AS BIGINT) AS raw,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'heal'), 0) AS BIGINT) AS heal,
  CAST(coalesce(sum(effective_amount) FILTER (type = 'absorb'), 0) AS BIGINT) AS absorb,
  min(us) FILTER (event = 'UNIT_DIED' AND target <> '' AND target <> player) AS kill_us
  FROM ev e JOIN player USING (log_id, combat_id) GROUP BY ALL)""",
        "duration_s dps hps first_kill_s overkill_pct",
    ),
    "damage_by_target": (
        """SELECT log_id, combat_id, target, damage, damage / CAST(sum(damage) OVER (PARTITION BY log_id, combat_id) AS BIGINT) * 100 AS pct,
  split_part(target, '-', 1) AS label FROM (
  SELECT e.log_id, e.combat_id, target, CAST(sum(effective_amount) AS BIGINT) AS damage
  FROM ev e JOIN player USING (log_id, combat_id)
  WHERE type = 'damage' AND target <> '' AND target <> player GROUP BY ALL)""",
        "pct",
    ),
    "main_target_hits": (
        """SELECT log_id, combat_id, target AS main_target FROM (
  SELECT log_id, combat_id, target, row_number() OVER (PARTITION BY log_id, combat_id
    ORDER BY count(*) DESC, target) AS r
  FROM ev WHERE type = 'damage' AND target <> '' AND target <> (
    SELECT source FROM ev GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
  GROUP BY log_id, combat_id, target) WHERE r = 1""",
        "",
    ),
    "recent_encounters": (
        """SELECT log_id, combat_id, split_part(player, '-', 1) AS player, coalesce(tgt, '') AS target,
  CASE WHEN span_us > 0 THEN format('[{:02d}:{:02d}]', span_us // 60000000, span_us // 1000000 % 60) ELSE '' END AS duration,
  dmg AS total_damage, heal AS total_heal
FROM (SELECT e.log_id, e.combat_id, player, max(us) - min(us) AS span_us,
    CAST(sum(effective_amount) FILTER (type = 'damage') AS BIGINT) AS dmg,
    CAST(coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS BIGINT) AS heal,
    first(target ORDER BY seq) FILTER (target <> '') AS first_target
  FROM ev e JOIN player USING (log_id, combat_id) GROUP BY ALL HAVING bool_or(type = 'damage')
  ORDER BY combat_id DESC LIMIT 25) a
LEFT JOIN (SELECT log_id, combat_id, target AS top FROM (SELECT log_id, combat_id, target,
    row_number() OVER (PARTITION BY log_id, combat_id ORDER BY damage DESC, target) AS r FROM (
      SELECT e.log_id, e.combat_id, target, sum(effective_amount) AS damage FROM ev e
      JOIN player USING (log_id, combat_id)
      WHERE type = 'damage' AND target <> '' AND target <> player GROUP BY ALL)) WHERE r = 1) b
  USING (log_id, combat_id), LATERAL (SELECT coalesce(b.top, a.first_target) AS tgt)
WHERE combat_id % 6 <> 0""",
        "",
    ),
    "loaded_encounters": (
        """SELECT count(DISTINCT combat_id) FILTER (combat_id <> 0) AS n_encounters, max(combat_id) AS latest_id FROM ev """,
        "",
    ),
    "recent_events": (
        f"""SELECT log_id, seq, us AS ts, event, source, spell_name, amount, effective_amount, type FROM ev
WHERE combat_id = {_LATEST} ORDER BY us DESC, seq DESC LIMIT 200""",
        "",
    ),
    "session_banner": (
        """SELECT strftime(d.day, '%Y-%m-%d') AS day, encounters, played_us / 1e6 AS played_s,
  CASE WHEN played_us >= 3600000000 THEN format('{}h {}m', played_us // 3600000000, played_us // 1000000 % 3600 // 60)
    ELSE format('{}m {}s', played_us // 60000000, played_us // 1000000 % 60) END AS played,
  b.combat_id AS best_combat_id, dps AS best_dps,
  CASE WHEN dps >= 1e6 THEN CAST(round_even(dps / 1e6, 0) AS BIGINT) || ' M'
    WHEN dps >= 1e3 THEN CAST(round_even(dps / 1e3, 0) AS BIGINT) || ' K'
    ELSE CAST(CAST(round_even(dps, 0) AS BIGINT) AS VARCHAR) END AS best_dps_label,
  coalesce(split_part(target, '-', 1), '') AS best_target
FROM (SELECT day, count(*) AS encounters, CAST(sum(span_us) AS BIGINT) AS played_us FROM day_enc GROUP BY day) d
JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY dps DESC, combat_id) AS r FROM day_enc WHERE dps IS NOT NULL) b
  ON b.day = d.day AND b.r = 1
LEFT JOIN (SELECT day, combat_id, target, row_number() OVER (PARTITION BY day, combat_id ORDER BY damage DESC, target) AS r
  FROM (SELECT CAST(e.ts AS DATE) AS day, e.combat_id, target, sum(effective_amount) AS damage
    FROM fights e JOIN player USING (log_id, combat_id)
    WHERE type = 'damage' AND target <> '' AND target <> player GROUP BY ALL)) t
  ON t.day = d.day AND t.combat_id = b.combat_id AND t.r = 1""",
        "played_s best_dps",
    ),
    "hour_activity": (
        f"""SELECT h.hour, coalesce(encounters, 0) AS encounters, coalesce(avg_dps, 0.0) AS avg_dps
FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN (
  SELECT start_us // 3600000000 % 24 AS hour, count(*) AS encounters, avg({_rate('dmg', 'dur')}) AS avg_dps
  FROM enc GROUP BY 1) USING (hour)""",
        "avg_dps",
    ),
    "next_combat_id": ("SELECT log_id, max(combat_id) AS max_combat_id FROM ev GROUP BY log_id", ""),
    "spell_damage": (_spells("type = 'damage'", top=10), "avg pct"),
    "spell_healing": (_spells(_HEAL, top=10, kind=True), "avg pct"),
    "combat_spells": (_spells("type IN ('damage', 'heal', 'absorb')", "log_id, combat_id", 7, True), "avg pct"),
    "character_spells_damage": (_spells("type = 'damage'", "source", 10, source="fights"), "avg pct"),
    "character_spells_healing": (_spells(_HEAL, "source", 10, True, source="fights"), "avg pct"),
    "most_cast": (
        f"""SELECT * FROM (SELECT *, 'damage' AS type FROM ({_spells("type = 'damage'", top=40, source='fights')})
UNION ALL SELECT *, 'heal' AS type FROM ({_spells(_HEAL, top=40, source='fights')}))
ORDER BY "count" DESC, spell, type LIMIT 25""",
        "avg pct",
    ),
    "ability_uptime": (
        """SELECT log_id, combat_id, spell, uses, seconds, uptime_pct FROM (
  SELECT t.log_id, t.combat_id, spell_name AS spell, count(*) AS uses,
    count(DISTINCT (us - start_us) // 1000000) AS seconds,
    count(DISTINCT (us - start_us) // 1000000) / greatest(1, CAST(ceil(any_value(span_us) / 1e6) AS BIGINT)) * 100 AS uptime_pct,
    row_number() OVER (PARTITION BY t.log_id, t.combat_id ORDER BY count(*) DESC, spell_name) AS r
  FROM timeline t JOIN starts USING (log_id, combat_id) GROUP BY t.log_id, t.combat_id, spell_name) WHERE r <= 20""",
        "uptime_pct",
    ),
    "rotation_timeline": (
        """SELECT t.log_id, t.combat_id, seq, spell_name, spell_rank, (us - start_us) / 1e6 AS elapsed_s, type, amount, effective_amount
FROM timeline t JOIN ranks USING (log_id, combat_id, spell_name) JOIN starts USING (log_id, combat_id) WHERE spell_rank <= 20""",
        "elapsed_s",
    ),
    "encounter_runs": (
        """SELECT log_id, combat_id, start_us AS start_ts, end_us AS end_ts, dur AS duration_s, dmg AS total_damage, heal AS total_heal,
  zone_name, zone_id, main_target, run_id FROM enc_runs """,
        "duration_s",
    ),
    "run_roles": ("SELECT * FROM roles ", ""),
    "runs": (
        """SELECT log_id, run_id, zone_name, zone_id, start_us AS start_ts, end_us AS end_ts, n_encounters,
  dmg AS total_damage, heal AS total_heal, dur AS duration_s, avg_dps, avg_hps, has_boss_kill, boss_names,
  run_role, is_healer_run, run_spec, run_class FROM run_rows """,
        "duration_s avg_dps avg_hps",
    ),
    "boss_runs": (
        """SELECT log_id, run_id, zone_name, boss_names, run_role FROM run_rows WHERE has_boss_kill AND zone_name IN ('Zone1', 'Zone2')""",
        "",
    ),
    "run_headline": (
        """SELECT count(*) AS runs, count(*) FILTER (has_boss_kill) AS boss_runs, count(DISTINCT zone_name) AS zones,
  CAST(sum(n_encounters) AS BIGINT) AS encounters, CAST(sum(dmg) AS BIGINT) AS total_damage,
  CAST(sum(heal) AS BIGINT) AS total_heal, round_even(avg(avg_dps), 1) AS avg_dps, round_even(avg(avg_hps), 1) AS avg_hps
FROM run_rows """,
        "avg_dps avg_hps",
    ),
    "run_table": (
        """SELECT r.log_id, r.run_id, zone_name, split_part(player, '-', 1) AS player, run_class AS player_class, run_role AS role,
  boss_names AS boss, strftime(make_timestamp(start_us), '%m/%d %H:%M') AS date, n_encounters AS encounters,
  format('{}:{:02d}', CAST(floor(dur) AS BIGINT) // 60, CAST(floor(dur) AS BIGINT) % 60) AS duration,
  dmg AS damage, heal AS healing, round_even(avg_dps, 1) AS avg_dps, round_even(avg_hps, 1) AS avg_hps
FROM run_rows r JOIN (SELECT log_id, run_id, source AS player FROM (
    SELECT e.log_id, run_id, source, row_number() OVER (PARTITION BY e.log_id, run_id ORDER BY count(*) DESC, source) AS n
    FROM ev e JOIN enc_runs USING (log_id, combat_id) GROUP BY e.log_id, run_id, source) WHERE n = 1) USING (log_id, run_id)""",
        "avg_dps avg_hps",
    ),
    "zone_totals": (
        """SELECT zone_name, count(*) AS runs, CAST(sum(dmg) AS BIGINT) AS total_damage, avg(avg_dps) AS avg_dps FROM run_rows GROUP BY zone_name""",
        "avg_dps",
    ),
    "participants": (
        f"""SELECT log_id, run_id, source, split_part(source, '-', 1) AS short_name,
  CASE WHEN source LIKE '%-%-%' THEN 'Player' ELSE 'Follower NPC' END AS role, damage,
  round_even({_rate('damage', 'active')}, 1) AS dps, healing, round_even({_rate('healing', 'active')}, 1) AS hps,
  round_even(CASE WHEN damage > 0 THEN damage END / CAST(sum(damage) OVER (PARTITION BY log_id, run_id) AS BIGINT) * 100, 1) AS damage_pct,
  round_even(CASE WHEN healing > 0 THEN healing END / CAST(sum(healing) OVER (PARTITION BY log_id, run_id) AS BIGINT) * 100, 1) AS healing_pct
FROM (SELECT s.log_id, run_id, source, CAST(sum(s.dmg) AS BIGINT) AS damage, CAST(sum(s.heal) AS BIGINT) AS healing,
    CAST(sum(r.span_us) AS BIGINT) / 1e6 AS active
  FROM per_source s JOIN enc_runs r USING (log_id, combat_id) GROUP BY ALL HAVING sum(s.dmg) + sum(s.heal) > 0)""",
        "dps hps damage_pct healing_pct",
    ),
    "participant_trend": (
        f"""SELECT s.log_id, run_id, s.combat_id, source, split_part(source, '-', 1) AS short_name,
  CASE WHEN source LIKE '%-%-%' THEN 'Player' ELSE 'Follower NPC' END AS role,
  round_even({_rate('s.dmg', 'r.dur')}, 1) AS dps, round_even({_rate('s.heal', 'r.dur')}, 1) AS hps
FROM per_source s JOIN enc_runs r USING (log_id, combat_id) WHERE s.dmg + s.heal > 0""",
        "dps hps",
    ),
    "run_encounters": ("SELECT * FROM enc_rows ", "dps hps"),
    "run_encounter_bars": (
        """SELECT log_id, run_id, combat_id, target, is_boss, stat, value, CASE WHEN stat = 'dps' THEN 'Damage' ELSE 'Support' END AS bar
FROM (SELECT log_id, run_id, combat_id, target, is_boss, 'dps' AS stat, dps AS value FROM enc_rows
  UNION ALL SELECT log_id, run_id, combat_id, target, is_boss, 'hps', hps FROM enc_rows
  UNION ALL SELECT log_id, run_id, combat_id, target, is_boss, 'absorb', CAST(absorb AS DOUBLE) FROM enc_rows )""",
        "value",
    ),
    "run_abilities_damage": (
        "SELECT *, spell || ' » ' || format('{:4.1f}%', pct) AS label FROM ("
        + _spells("type = 'damage'", "log_id, run_id", 200, source="run_ev")
        + ")",
        "avg pct",
    ),
    "run_abilities_healing": (
        "SELECT *, spell || ' » ' || format('{:4.1f}%', pct) AS label FROM ("
        + _spells(_HEAL, "log_id, run_id", 200, source="run_ev")
        + ")",
        "avg pct",
    ),
    "time_series": ("SELECT log_id, combat_id, bucket AS bucket_ts, dps, hps FROM series ", ""),
    "time_series_spell": (
        "SELECT log_id, combat_id, bucket AS bucket_ts, dps, hps, sel_d AS selected_dps, sel_h AS selected_hps FROM series ",
        "",
    ),
    "time_series_spell_damage": (
        "SELECT log_id, combat_id, bucket AS bucket_ts, dps, hps, sel_d AS selected_dps, CAST(0 AS BIGINT) AS selected_hps FROM series ",
        "",
    ),
    "smooth": (
        """SELECT log_id, combat_id, bucket AS bucket_ts, avg(dps) OVER w AS dps, avg(hps) OVER w AS hps FROM series
WINDOW w AS (PARTITION BY log_id, combat_id ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING)""",
        "dps hps",
    ),
    "series_long": (
        """SELECT log_id, combat_id, bucket AS bucket_ts, 'dps' AS metric, dps AS value FROM series WHERE dps > 0
UNION ALL SELECT log_id, combat_id, bucket, 'hps', hps FROM series WHERE hps > 0""",
        "",
    ),
    "encounter_trend": ("SELECT * FROM trend ", "dps hps dps_roll hps_roll"),
    "trend_long": (
        """SELECT log_id, combat_id, 'dps' AS metric, dps AS value FROM trend
UNION ALL SELECT log_id, combat_id, 'hps', hps FROM trend
UNION ALL SELECT log_id, combat_id, 'dps_roll', dps_roll FROM trend
UNION ALL SELECT log_id, combat_id, 'hps_roll', hps_roll FROM trend """,
        "value",
    ),
    "cumulative_frames": (
        """SELECT g.log_id, g.combat_id, g.source, g.frame, CAST(coalesce(sum(d) OVER (PARTITION BY g.log_id, g.combat_id, g.source
    ORDER BY g.frame ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS damage
FROM (SELECT log_id, combat_id, source, unnest(range(greatest(1, (span_us + 59999999) // 60000000) + 1)) AS frame FROM (
    SELECT e.log_id, e.combat_id, source, any_value(span_us) AS span_us, row_number() OVER (PARTITION BY e.log_id, e.combat_id
      ORDER BY sum(effective_amount) DESC, source) AS r
    FROM ev e JOIN starts USING (log_id, combat_id) WHERE type = 'damage' GROUP BY e.log_id, e.combat_id, source)) g
LEFT JOIN (SELECT e.log_id, e.combat_id, source, (us - start_us + 59999999) // 60000000 AS frame, sum(effective_amount) AS d
  FROM ev e JOIN starts USING (log_id, combat_id) WHERE type = 'damage' GROUP BY ALL) s
  ON s.log_id = g.log_id AND s.combat_id = g.combat_id AND s.source = g.source AND s.frame = g.frame""",
        "",
    ),
    "fingerprints": ("SELECT character, log_id, combat_id, targets FROM prints ", ""),
    "encounter_sequence": (
        f"""SELECT source, log_id, combat_id, dur AS duration_s, dmg AS total_damage, heal AS total_heal,
  {_rate('dmg', 'dur')} AS dps, {_rate('heal', 'dur')} AS hps,
  row_number() OVER (PARTITION BY source ORDER BY combat_id) AS enc_seq
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY combat_id DESC) AS r FROM per_source )""",
        "duration_s dps hps",
    ),
    "pair_exact": (
        """SELECT 'main' AS ref_log_id, ref_combat_id, character, log_id, combat_id, label FROM pairs """,
        "",
    ),
    "paired_metrics": (
        f"""SELECT 'main' AS ref_log_id, ref_combat_id, split_part(character, '-', 1) AS character, p.log_id, p.combat_id, label,
  {_rate('dmg', 'dur')} AS dps, {_rate('heal', 'dur')} AS hps, dur AS duration_s
FROM pairs p JOIN per_source s ON s.source = p.character AND s.log_id = p.log_id AND s.combat_id = p.combat_id""",
        "dps hps duration_s",
    ),
    "pair_table": (
        """SELECT 'main' AS ref_log_id, ref_combat_id, label,
  max(combat_id) FILTER (character = 'P0-Realm-EU') AS "P0-Realm-EU",
  max(combat_id) FILTER (character = 'P2-Realm-EU') AS "P2-Realm-EU" FROM pairs GROUP BY ref_combat_id, label""",
        "",
    ),
    "every_pair_exact": (
        """SELECT comparison, 'main' AS ref_log_id, ref_combat_id, character, log_id, combat_id, label FROM every_pairs """,
        "",
    ),
    "every_paired_metrics": (
        f"""SELECT comparison, 'main' AS ref_log_id, ref_combat_id, split_part(character, '-', 1) AS character, p.log_id, p.combat_id, label,
  {_rate('dmg', 'dur')} AS dps, {_rate('heal', 'dur')} AS hps, dur AS duration_s
FROM every_pairs p JOIN per_source s ON s.source = p.character AND s.log_id = p.log_id AND s.combat_id = p.combat_id""",
        "dps hps duration_s",
    ),
    "every_pair_table": (
        """SELECT comparison, 'main' AS ref_log_id, ref_combat_id, label,
  min(character) AS character_1, 'main' AS log_id_1, arg_min(combat_id, character) AS combat_id_1,
  max(character) AS character_2, 'main' AS log_id_2, arg_max(combat_id, character) AS combat_id_2
FROM every_pairs GROUP BY comparison, ref_combat_id, label""",
        "",
    ),
    "boss_encounters": (
        "SELECT * RENAME (start_us AS start_ts, end_us AS end_ts) FROM boss ",
        "duration_s dps hps",
    ),
    "boss_list": ("SELECT boss_name, count(*) AS kills FROM boss GROUP BY boss_name", ""),
    "kill_overview": (
        """SELECT boss_name, log_id, combat_id, character_short AS character, run_role AS role, run_spec AS spec,
  strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M') AS date,
  format('{}:{:02d}', CAST(floor(duration_s) AS BIGINT) // 60, CAST(floor(duration_s) AS BIGINT) % 60) AS duration, dps, hps FROM boss """,
        "dps hps",
    ),
    "kill_options": (
        """SELECT boss_name, log_id, combat_id, CASE WHEN n = 0 THEN base ELSE base || ' [' || n || ']' END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY boss_name, base ORDER BY start_us DESC, combat_id) - 1 AS n FROM (
  SELECT *, character_short || ' (' || run_role || ') — ' || strftime(make_timestamp(start_us), '%m/%d %H:%M') || ' — '
    || format('{}:{:02d}', CAST(floor(duration_s) AS BIGINT) // 60, CAST(floor(duration_s) AS BIGINT) % 60) || ' — '
    || CASE WHEN dps > hps THEN 'DPS ' ELSE 'HPS ' END
    || CASE WHEN greatest(dps, hps) >= 1e6 THEN CAST(round_even(greatest(dps, hps) / 1e6, 0) AS BIGINT) || ' M'
      WHEN greatest(dps, hps) >= 1e3 THEN CAST(round_even(greatest(dps, hps) / 1e3, 0) AS BIGINT) || ' K'
      ELSE CAST(CAST(round_even(greatest(dps, hps), 0) AS BIGINT) AS VARCHAR) END AS base FROM boss ))""",
        "",
    ),
    "newest_kill_deltas": (
        """SELECT a.log_id, a.boss_name, a.combat_id AS left_id, b.combat_id AS right_id, a.dps - b.dps AS delta_dps,
  a.hps - b.hps AS delta_hps, a.duration_s - b.duration_s AS delta_duration_s
FROM (SELECT *, row_number() OVER (PARTITION BY log_id, boss_name ORDER BY start_us DESC, combat_id) AS r FROM boss ) a
JOIN (SELECT *, row_number() OVER (PARTITION BY log_id, boss_name ORDER BY start_us DESC, combat_id) AS r FROM boss ) b
  ON a.log_id = b.log_id AND a.boss_name = b.boss_name AND a.r = 1 AND b.r = 2""",
        "delta_dps delta_hps delta_duration_s",
    ),
    "rotation_compare": (
        f"""SELECT log_id, side, spell_name, position, elapsed_s, type, effective_amount, is_padding FROM (
  SELECT t.log_id, CASE WHEN t.combat_id = {_LATEST} THEN 'Left' ELSE 'Right' END AS side, t.spell_name, position,
    (us - start_us) / 1e6 AS elapsed_s, type, effective_amount, false AS is_padding
  FROM timeline t JOIN starts USING (log_id, combat_id) JOIN places p ON p.spell_name = t.spell_name
  WHERE t.combat_id IN ({_LATEST}, {_OLDEST})
  UNION ALL
  SELECT 'main', side, spell_name, position, -1.0, 'damage', CAST(0 AS BIGINT), true FROM places CROSS JOIN (
    VALUES ('Left', {_LATEST}), ('Right', {_OLDEST})) s (side, cid)
  WHERE NOT EXISTS (SELECT 1 FROM timeline t WHERE t.combat_id = s.cid AND t.spell_name = places.spell_name))""",
        "elapsed_s",
    ),
    "upsert_note": (
        """SELECT combat_id, CASE WHEN combat_id % 4 = 0 THEN 'new ' || combat_id ELSE 'note ' || combat_id END AS note
FROM (SELECT DISTINCT combat_id FROM fights ) WHERE (combat_id % 3 = 0 OR combat_id % 4 = 0) AND combat_id % 6 <> 0""",
        "",
    ),
    "toggle_hidden": (
        """SELECT combat_id FROM (SELECT DISTINCT combat_id FROM fights ) WHERE (combat_id % 2 = 0) <> (combat_id % 3 = 0)""",
        "",
    ),
    "parse_raw_events": (
        """SELECT log_id, seq, us AS ts, event, src_guid, src_name, src_flags, dst_guid, dst_name, dst_flags FROM raw """,
        "",
    ),
    "parse_player_events": ("SELECT * RENAME (us AS ts) FROM parsed ", ""),
    "parse_zone_changes": (
        """SELECT log_id, seq, us AS ts, user_id % 4 AS zone_id, CASE WHEN k % 20 = 0 THEN 'UNKNOWN AREA' ELSE 'Zone' || (user_id % 4) END AS zone_name
FROM lines WHERE event_type = 'error' AND k % 10 = 0""",
        "",
    ),
    "parse_boss_markers": (
        """SELECT log_id, seq, us AS ts, marker, boss_name, CASE WHEN marker = 'START' THEN zone END AS zone_id,
  CASE WHEN marker = 'END' THEN flag END AS kill_flag FROM markers """,
        "",
    ),
    "pair_boss_kills": (
        """SELECT log_id, seq, prev_boss AS boss_name, prev_us AS start_ts, us AS end_ts, flag AS kill_flag, prev_zone AS zone_id
FROM (SELECT *, lag(marker) OVER w AS prev, lag(boss_name) OVER w AS prev_boss, lag(us) OVER w AS prev_us, lag(zone) OVER w AS prev_zone
  FROM markers WINDOW w AS (PARTITION BY log_id ORDER BY seq)) WHERE marker = 'END' AND prev = 'START'""",
        "",
    ),
    "active_character": (
        """SELECT log_id, arg_min(pname, seq) AS active_character FROM lines WHERE own_flags = 1297
  AND (event_type IN ('click', 'view', 'signup') OR (event_type = 'purchase' AND k % 2 = 0)) GROUP BY log_id""",
        "",
    ),
    "log_summary": (
        """SELECT log_id, dmg AS total_damage, heal AS total_heal, dur AS duration_s, dmg / dur AS avg_dps, heal / dur AS avg_hps
FROM (SELECT log_id, CAST(sum(effective_amount) FILTER (type = 'damage') AS BIGINT) AS dmg,
  CAST(sum(effective_amount) FILTER (type <> 'damage') AS BIGINT) AS heal,
  (arg_max(us, seq) - arg_min(us, seq)) / 1e6 AS dur FROM parsed GROUP BY log_id)""",
        "duration_s avg_dps avg_hps",
    ),
    "extract_positions": (
        """SELECT log_id, seq, round_even((us - 1704067200000000) / 1e6, 2) AS t, pguid AS guid, x, y FROM located """,
        "t x y",
    ),
    "position_units": (
        """SELECT log_id, guid, name, role, CASE WHEN role = 'actor' THEN (row_number() OVER (PARTITION BY log_id, role ORDER BY seq) - 1) % 6 END AS color_slot
FROM (SELECT log_id, guid, arg_min(name, place) AS name, arg_min(role, place) AS role, min(place) AS seq FROM (
  SELECT log_id, seq * 2 AS place, pguid AS guid, pname AS name, 'actor' AS role FROM located
  UNION ALL SELECT log_id, seq * 2 + 1, CASE event_type WHEN 'view' THEN pguid ELSE eguid END,
    CASE event_type WHEN 'view' THEN pname ELSE ename END, 'target' FROM located ) GROUP BY log_id, guid)""",
        "",
    ),
}
_LABEL = (
    "array_to_string(list_slice(string_split(targets, ','), 1, 4), ', ') || CASE WHEN len(string_split(targets, ',')) > 4 "
    "THEN ' +' || (len(string_split(targets, ',')) - 4) ELSE '' END AS label"
)
_BODIES["pair_alike"] = (
    f"""SELECT 'main' AS ref_log_id, ref_id AS ref_combat_id, character, 'main' AS log_id, combat_id, {_LABEL} FROM (
  SELECT ref_id, character, combat_id, targets FROM pair_steps s JOIN alike a ON a.i = s.i AND a.combat_id = s.picked
  UNION ALL SELECT r.combat_id, r.character, r.combat_id, r.targets FROM pair_steps s JOIN refs r ON r.i = s.i WHERE picked IS NOT NULL)""",
    "",
)
_BODIES["spell_filter_options"] = (
    f"""SELECT log_id, combat_id, option, spell, kind, row_number() OVER (PARTITION BY log_id, combat_id ORDER BY side, total DESC, spell) AS position
FROM (SELECT log_id, combat_id, 0 AS side, total, spell, 'damage' AS kind, spell || ' [Damage]' AS option
    FROM ({_spells("type = 'damage'", 'log_id, combat_id', 7)})
  UNION ALL SELECT log_id, combat_id, 1, total, spell, 'healing', spell || ' [Healing]'
    FROM ({_spells(_HEAL, 'log_id, combat_id', 7)}))""",
    "",
)
_BODIES["detect_encounters"] = (
    """SELECT log_id, combat_id, open_seq, start_us AS start_ts, end_us AS end_ts, array_to_string(guids, ',') AS enemy_guids,
  zone_id, zone_name, CASE WHEN reason = 'timeout' AND combat_id = n THEN 'end_of_log' ELSE reason END AS close_reason FROM zoned """,
    "",
)
_BODIES["stamped_events"] = (
    """SELECT p.log_id, seq, coalesce(z.combat_id, 0) AS combat_id, us AS ts, event, source, target, spell_name, amount,
  effective_amount, type, coalesce(z.zone_id, 0) AS zone_id, coalesce(z.zone_name, '') AS zone_name, spell_id
FROM parsed p LEFT JOIN (SELECT *, lead(start_us) OVER (PARTITION BY log_id ORDER BY combat_id) AS next_us FROM zoned ) z
  ON z.log_id = p.log_id AND p.us BETWEEN z.start_us AND z.end_us AND (z.next_us IS NULL OR p.us < z.next_us)""",
    "",
)
_BODIES["target_totals"] = (
    f"""SELECT target, encounters, total_time_s, total_damage, total_heal, {_rate('total_damage', 'total_time_s')} AS dps,
  {_rate('total_heal', 'total_time_s')} AS hps
FROM (SELECT target, count(*) AS encounters, CAST(sum(span) AS BIGINT) / 1e6 AS total_time_s,
  CAST(sum(dmg) AS BIGINT) AS total_damage, CAST(sum(heal) AS BIGINT) AS total_heal FROM (
  SELECT target, log_id, combat_id, max(us) - min(us) AS span,
    coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS dmg,
    coalesce(sum(effective_amount) FILTER (type IN ('heal', 'absorb')), 0) AS heal
  FROM ev WHERE target <> '' GROUP BY ALL) GROUP BY target)""",
    "total_time_s dps hps",
)
_BODIES["totals_view"] = (
    f"SELECT * FROM ({_BODIES['target_totals'][0]}) ORDER BY encounters DESC, total_damage DESC, target LIMIT 50",
    "total_time_s dps hps",
)
_BODIES["target_totals_character"] = (
    _BODIES["target_totals"][0].replace("FROM ev WHERE target <> ''", "FROM ev WHERE source = 'P0-Realm-EU' AND target <> ''"),
    _BODIES["target_totals"][1],
)
_BODIES["totals_meta_character"] = (
    """SELECT count(*) AS total_combats, CAST(sum(span) AS BIGINT) / 1e6 AS total_duration_s,
  (SELECT count(DISTINCT target) FROM ev WHERE source = 'P0-Realm-EU' AND target <> '') AS unique_targets
FROM (SELECT max(us) - min(us) AS span FROM ev WHERE source = 'P0-Realm-EU' GROUP BY log_id, combat_id)""",
    "total_duration_s",
)
_BODIES["session_banner_day"] = (
    f"SELECT * FROM ({_BODIES['session_banner'][0]}) WHERE day = '2024-01-10'",
    _BODIES["session_banner"][1],
)
_BODIES["damage_by_target_top"] = (
    f"""SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY log_id, combat_id ORDER BY damage DESC, target) AS r
  FROM ({_BODIES['damage_by_target'][0]})) WHERE r <= 3""",
    "pct",
)
_BODIES["most_cast_all"] = (
    f"""SELECT *, 'damage' AS type FROM ({_spells("type = 'damage'", top=1000000, source='fights')})
UNION ALL SELECT *, 'heal' AS type FROM ({_spells(_HEAL, top=1000000, source='fights')})""",
    "avg pct",
)
_BODIES["extract_positions_range"] = (
    """SELECT log_id, seq, round_even((us - 1704070800000000) / 1e6, 2) AS t, pguid AS guid, x, y FROM located
WHERE us BETWEEN 1704070800000000 AND 1704078000000000""",
    "t x y",
)
_BODIES["replay_duration"] = ("SELECT log_id, combat_id, span_us / 1e6 AS duration_s FROM starts ", "duration_s")
_BODIES["cumulative_spans"] = (
    """SELECT log_id, combat_id, source, frame AS from_frame,
  coalesce(lead(frame) OVER w - 1, greatest(1, (span + 999999) // 1000000)) AS to_frame, CAST(sum(d) OVER w AS BIGINT) AS damage
FROM (SELECT e.log_id, e.combat_id, source, (us - start_us + 999999) // 1000000 AS frame, sum(effective_amount) AS d,
    any_value(span_us) AS span FROM ev e JOIN starts USING (log_id, combat_id) WHERE type = 'damage' GROUP BY ALL)
WINDOW w AS (PARTITION BY log_id, combat_id, source ORDER BY frame)
UNION ALL SELECT e.log_id, e.combat_id, source, 0, (min(us - start_us) + 999999) // 1000000 - 1, 0
FROM ev e JOIN starts USING (log_id, combat_id) WHERE type = 'damage'
GROUP BY ALL HAVING (min(us - start_us) + 999999) // 1000000 > 0""",
    "",
)
for _policy, _choice in {
    "damage": "coalesce(by_damage, first_seen, longest)",
    "header": "coalesce(by_hits, longest, first_time)",
}.items():
    _BODIES[f"main_target_{_policy}"] = (
        f"""SELECT log_id, combat_id, {_choice} AS main_target FROM (
  SELECT log_id, combat_id,
    first(target ORDER BY dmg DESC, target) FILTER (hits > 0 AND other) AS by_damage,
    first(target ORDER BY hits DESC, target) FILTER (hits > 0 AND other) AS by_hits,
    first(target ORDER BY span DESC, target) FILTER (span > 0 AND other) AS longest,
    first(target ORDER BY first_seq) AS first_seen, first(target ORDER BY first_us, first_seq) AS first_time
  FROM (SELECT e.log_id, e.combat_id, target, target <> player AS other,
      count(*) FILTER (type = 'damage') AS hits, coalesce(sum(effective_amount) FILTER (type = 'damage'), 0) AS dmg,
      max(us) - min(us) AS span, min(seq) AS first_seq, min(us) AS first_us
    FROM ev e JOIN player USING (log_id, combat_id) WHERE target <> '' GROUP BY ALL) GROUP BY ALL)""",
        "",
    )


for _name in ("encounter_stats", "overall_stats"):
    _body, _round = _BODIES[_name]
    _BODIES[f"orders_{_name}"] = (_body.replace("FROM enc ", "FROM oenc "), _round)
for _name in ("target_totals", "character_counts"):
    _body, _round = _BODIES[_name]
    _BODIES[f"orders_{_name}"] = (_body.replace("FROM ev ", "FROM oev "), _round)
_BODIES["orders_spells"] = (
    _spells("type IN ('damage', 'heal', 'absorb')", kind=True, source="oev"),
    "avg pct",
)


def _finish(body: str, rounded: str) -> str:
    if not rounded:
        return _sql(body)
    changes = ", ".join(f'round("{c}", 6) AS "{c}"' for c in rounded.split())
    return _sql(f"SELECT * REPLACE ({changes}) FROM (\n{body}\n)")


def sql_twins() -> dict[str, str]:
    return {name: _finish(body, rounded) for name, (body, rounded) in _BODIES.items()}
