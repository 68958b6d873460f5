"""DuckDB statements for the registered queries, written independently of the Spark code.

`_VIEWS` states the clinical views over the star tables; `_ANCHORED`, `_RESEARCH` and
`_ROLLING` state the flows step by step, with plain range joins. A statement that is not
reached from a query's final SELECT is not run."""

from __future__ import annotations

_VIEWS = """
c_person AS (
  SELECT c_custkey AS person_id, CAST(1925 + c_custkey % 85 AS INTEGER) AS year_of_birth,
    CASE WHEN c_custkey % 10 = 9 THEN 'No matching concept' WHEN c_custkey % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END AS gender,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Chinese' WHEN 'BUILDING' THEN 'Black or African American'
      WHEN 'FURNITURE' THEN 'White' WHEN 'HOUSEHOLD' THEN 'Other Race' ELSE 'No information' END AS race,
    CASE c_custkey % 3 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic or Latino'
      ELSE 'No matching concept' END AS ethn,
    c_nationkey AS site FROM customer),
c_manifest AS (SELECT n_nationkey AS site, DATE '2026-08-01' AS run_date FROM nation),
c_death AS (
  SELECT c_custkey AS person_id, DATE '2024-01-01' + CAST(c_custkey % 500 AS INTEGER) AS death_date
  FROM customer WHERE c_custkey % 97 = 0),
c_visit AS (
  SELECT o_orderkey AS vid, o_custkey AS person_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 9201 WHEN '2-HIGH' THEN 9203 WHEN '3-MEDIUM' THEN 9202 ELSE 581477 END AS kind,
    o_orderpriority AS kind_name, CAST(o_orderdate AS DATE) + 9131 AS vstart,
    CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) + 9131 + CAST(o_orderkey % 200 - 2 AS INTEGER) END AS vend,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS hosp
  FROM orders),
c_line AS (
  SELECT l.*, o_custkey AS person_id, l_orderkey * 10 + l_linenumber AS fact_id,
    CAST(o_orderdate AS DATE) + 9131 + CAST(l_linenumber AS INTEGER) AS fdate,
    CASE WHEN l_linestatus <> 'O' THEN l_orderkey END AS fvisit
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
c_cond AS (
  SELECT fact_id, person_id,
    CASE l_partkey % 100 WHEN 1 THEN 37311061 WHEN 2 THEN 705076 WHEN 3 THEN 36714927 ELSE l_partkey END AS cid,
    'part ' || l_partkey || CASE WHEN l_partkey % 50 = 7 THEN ' finding' ELSE '' END AS cname,
    CASE WHEN l_partkey % 333 = 5 THEN 'U09.9' ELSE 'S' || l_suppkey END AS source_value, fdate, fvisit
  FROM c_line),
c_drug AS (
  SELECT person_id, l_partkey AS did,
    'part ' || l_partkey || CASE WHEN l_partkey % 50 = 7 THEN ' finding' ELSE '' END AS dname, fdate, fvisit
  FROM c_line WHERE l_returnflag = 'N'),
c_meas AS (
  SELECT fact_id, person_id, CASE WHEN l_partkey % 10 = 4 THEN 706163 ELSE l_partkey END AS mid,
    CASE WHEN l_suppkey % 5 = 0 THEN 45884084 ELSE 45878583 END AS result, fdate, fvisit,
    CASE WHEN l_suppkey % 7 <> 0 THEN l_quantity END AS val, l_linenumber % 2 AS unit
  FROM c_line WHERE l_returnflag = 'R'),
c_proc AS (SELECT fact_id, person_id, fdate, fvisit FROM c_line WHERE l_returnflag = 'A'),
c_obs AS (
  SELECT event_id AS oid, user_id AS person_id,
    CASE event_type WHEN 'purchase' THEN 2004207791 WHEN 'view' THEN 10000001 WHEN 'click' THEN 10000002
      WHEN 'signup' THEN 10000003 ELSE 10000004 END AS cid, event_type AS cname, CAST(ts AS DATE) - 500 AS fdate
  FROM events),
c_flag AS (
  SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) + 9131 AS d,
    o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS pcr,
    o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 250000 AS dx,
    o_orderstatus = 'P' AND o_totalprice < 120000 AS pax1,
    o_orderstatus = 'P' AND o_totalprice >= 60000 AND o_totalprice < 150000 AS pax2,
    o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND o_totalprice >= 400000 AS pax,
    o_orderpriority = '3-MEDIUM' AND o_totalprice >= 450000 AS rem,
    o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice >= 400000 AS lc,
    o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice < 30000 AS b94,
    o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 40000 AS misc
  FROM orders),
c_part AS (
  SELECT p_partkey AS k, CAST(substr(p_brand, 7) AS BIGINT) AS b,
    CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
      WHEN 'SMALL' THEN 5 ELSE 6 END AS t FROM part),
c_concept AS (
  SELECT k AS id, 'part ' || k || CASE WHEN k % 50 = 7 THEN ' finding' ELSE '' END AS name,
    CASE WHEN k % 11 = 0 THEN 'Drug' WHEN k % 3 = 0 THEN 'Observation' ELSE 'Condition' END AS dom, 'SNOMED' AS voc, 'Leaf' AS cls
  FROM c_part
  UNION ALL SELECT DISTINCT 10000000 + b, 'group ' || b || CASE WHEN b % 10 = 0 THEN ' finding' ELSE '' END,
    'Condition', 'SNOMED', 'Group' FROM c_part
  UNION ALL SELECT DISTINCT 20000000 + t, CASE t WHEN 4 THEN 'Chronic disease' WHEN 5 THEN 'Left side' ELSE 'type ' || t END,
    'Condition', 'SNOMED', 'Type' FROM c_part
  UNION ALL SELECT DISTINCT 30000000 + b, 'Ingredient-' || b, 'Drug', 'RxNorm', 'Ingredient' FROM c_part),
c_edge AS (
  SELECT k AS anc, k AS des, 0 AS lvl FROM c_part
  UNION ALL SELECT 10000000 + b, k, 1 FROM c_part
  UNION ALL SELECT 20000000 + t, k, 2 FROM c_part
  UNION ALL SELECT 30000000 + b, k, 1 FROM c_part
  UNION ALL SELECT DISTINCT 10000000 + b, 10000000 + b, 0 FROM c_part
  UNION ALL SELECT DISTINCT 30000000 + b, 30000000 + b, 0 FROM c_part
  UNION ALL SELECT DISTINCT 20000000 + t, 20000000 + t, 0 FROM c_part),
c_set AS (SELECT p_brand AS set_name, p_partkey AS cid, p_size >= 10 AS latest FROM part),
c_sequel AS (
  SELECT c_custkey AS person_id, DATE '2021-06-01' + CAST(c_custkey % 700 AS INTEGER) AS lc_date
  FROM customer WHERE c_custkey % 6 = 0)
"""

_EPISODES = """
scaffold AS (
  SELECT * FROM c_visit WHERE vstart IS NOT NULL AND vend IS NOT NULL AND vstart <= vend AND (
    kind IN (9201, 8717, 262, 32037, 581379)
    OR (kind = 9202 AND vend - vstart = 1) OR (kind = 9203 AND vend - vstart >= 1))),
reach AS (SELECT *, max(vend) OVER (PARTITION BY person_id ORDER BY vstart) AS m FROM scaffold),
gaps AS (
  SELECT *, CASE WHEN vstart <= lag(m) OVER (PARTITION BY person_id ORDER BY vstart) THEN 0 ELSE 1 END AS gap FROM reach),
islands AS (SELECT *, sum(gap) OVER (PARTITION BY person_id ORDER BY vstart) AS g FROM gaps),
spans AS (
  SELECT person_id, CAST(g AS BIGINT) AS g, min(vstart) AS mstart, max(vend) AS mend,
    person_id || '_' || CAST(g AS BIGINT) || '_' || strftime(min(vstart), '%Y%m%d') AS mid
  FROM islands GROUP BY person_id, g),
first_map AS (
  SELECT v.*, mid, mstart, mend FROM c_visit v LEFT JOIN spans s
  ON v.person_id = s.person_id AND vstart BETWEEN mstart AND mend),
good AS (SELECT DISTINCT mid FROM first_map WHERE kind IN (9201, 8717, 262, 32037, 581379, 9203) AND mid IS NOT NULL),
vmap AS (
  SELECT v.*, f.mid, f.mstart, f.mend FROM c_visit v
  LEFT JOIN (SELECT * FROM first_map WHERE mid IN (SELECT mid FROM good)) f ON v.vid = f.vid),
episodes AS (SELECT DISTINCT person_id, mid, mstart, mend FROM vmap WHERE mid IS NOT NULL)
"""

_ANCHORED = """
u099 AS (SELECT person_id, min(fdate) AS d FROM c_cond WHERE cid IN (710706, 705076) OR source_value LIKE '%U09.9%' GROUP BY 1),
u07 AS (SELECT person_id, min(fdate) AS d FROM c_cond WHERE cid = 37311061 GROUP BY 1),
lab AS (SELECT person_id, min(fdate) AS d FROM c_meas WHERE mid = 706163 AND result = 45884084 GROUP BY 1),
idx AS (
  SELECT p.person_id, lab.d AS pos_test_idx, u07.d AS u07_any_idx, u099.d AS u099_idx
  FROM (SELECT person_id FROM u099 UNION SELECT person_id FROM u07 UNION SELECT person_id FROM lab) p
  LEFT JOIN lab USING (person_id) LEFT JOIN u07 USING (person_id) LEFT JOIN u099 USING (person_id)),
base AS (
  SELECT DISTINCT i.person_id, CAST(year(run_date) - year_of_birth AS INTEGER) AS apprx_age, gender AS sex, race, ethn,
    p.site AS site_id, least(pos_test_idx, u07_any_idx) AS min_covid_dt, run_date
  FROM idx i JOIN c_person p USING (person_id) JOIN c_manifest m ON p.site = m.site LEFT JOIN c_death d ON d.person_id = i.person_id
  WHERE run_date - least(pos_test_idx, u07_any_idx, death_date) >= 100),
hosp_cases AS (
  SELECT DISTINCT b.person_id FROM base b JOIN vmap v ON b.person_id = v.person_id
  WHERE mstart BETWEEN min_covid_dt - 14 AND min_covid_dt + 14
  UNION SELECT b.person_id FROM base b JOIN vmap v ON b.person_id = v.person_id JOIN c_cond c ON v.vid = c.fvisit
  WHERE v.mid IS NOT NULL AND cid = 37311061),
grp AS (
  SELECT *, CASE WHEN person_id IN (SELECT person_id FROM hosp_cases) THEN 'CASE_HOSP' ELSE 'CASE_NONHOSP' END AS patient_group
  FROM base),
win AS (
  SELECT *, min_covid_dt - 365 AS pre_start, min_covid_dt - 45 AS pre_end, min_covid_dt + 45 AS post_start,
    CASE WHEN min_covid_dt + 300 < run_date THEN min_covid_dt + 300 ELSE run_date END AS post_end FROM grp),
span_days AS (SELECT person_id, max(vstart) - min(vstart) AS days FROM vmap GROUP BY 1),
ftb AS (
  SELECT w.*, days AS tot_long_data_days, CAST(count(DISTINCT vstart) AS BIGINT) AS post_visits_count,
    post_end - post_start AS tot_post_days, count(DISTINCT vstart) / 300 AS op_ratio
  FROM win w JOIN span_days s ON w.person_id = s.person_id
  LEFT JOIN vmap v ON w.person_id = v.person_id AND vstart BETWEEN post_start AND post_end AND mid IS NULL
  WHERE days > 1 GROUP BY ALL HAVING count(DISTINCT vstart) >= 1),
ipd AS (
  SELECT person_id, post_start, post_end, CAST(sum(mend - mstart + 1) AS BIGINT) AS tot_ip_days FROM (
    SELECT DISTINCT f.person_id, post_start, post_end, mstart, mend FROM ftb f JOIN vmap v ON f.person_id = v.person_id
    WHERE mstart BETWEEN post_start AND post_end) GROUP BY ALL),
demo AS (
  SELECT f.person_id, patient_group, apprx_age, sex, race, ethn, CAST(tot_long_data_days AS INTEGER) AS tot_long_data_days,
    op_ratio AS op_post_visit_ratio, coalesce(tot_ip_days, 0) / tot_post_days AS ip_post_visit_ratio
  FROM ftb f LEFT JOIN ipd USING (person_id)),
enc AS (SELECT vid, coalesce(mid, CAST(vid AS VARCHAR)) AS e FROM vmap),
dx_pre AS (
  SELECT f.person_id, cid, cname, count(DISTINCT e) AS n FROM ftb f JOIN c_cond c ON f.person_id = c.person_id
    AND fdate BETWEEN pre_start AND pre_end JOIN enc ON vid = fvisit GROUP BY ALL),
dx_post AS (
  SELECT f.person_id, cid, cname, count(DISTINCT e) AS n FROM ftb f JOIN c_cond c ON f.person_id = c.person_id
    AND fdate BETWEEN post_start AND post_end JOIN enc ON vid = fvisit GROUP BY ALL),
dxc AS (
  SELECT x.*, d.* EXCLUDE (person_id) FROM (
    SELECT coalesce(a.person_id, b.person_id) AS person_id, coalesce(a.cid, b.cid) AS cid, coalesce(a.cname, b.cname) AS cname,
      CAST(coalesce(a.n, 0) AS BIGINT) AS pre_n, CAST(coalesce(b.n, 0) AS BIGINT) AS post_n
    FROM dx_pre a FULL JOIN dx_post b ON a.person_id = b.person_id AND a.cid = b.cid AND a.cname = b.cname) x
  JOIN demo d ON x.person_id = d.person_id),
roll AS (
  SELECT DISTINCT r.person_id, fdate, fvisit, did, dname, id AS ing_id, name AS ing
  FROM c_drug r JOIN ftb f ON r.person_id = f.person_id JOIN c_edge ON des = did
  JOIN c_concept ON id = anc AND dom = 'Drug' AND lower(voc) = 'rxnorm' AND cls = 'Ingredient'),
med_side AS (
  SELECT f.person_id, ing_id, ing, e, fdate BETWEEN pre_start AND pre_end AS is_pre
  FROM ftb f JOIN roll r ON f.person_id = r.person_id
    AND (fdate BETWEEN pre_start AND pre_end OR fdate BETWEEN post_start AND post_end) JOIN enc ON vid = fvisit),
medc AS (
  SELECT x.*, d.* EXCLUDE (person_id) FROM (
    SELECT person_id, ing_id, ing, CAST(count(DISTINCT CASE WHEN is_pre THEN e END) AS BIGINT) AS pre_n,
      CAST(count(DISTINCT CASE WHEN NOT is_pre THEN e END) AS BIGINT) AS post_n FROM med_side GROUP BY ALL) x
  JOIN demo d ON x.person_id = d.person_id),
cand AS (
  SELECT p.name AS parent, cname AS child, d.cid AS child_id, lvl, CAST(count(DISTINCT d.person_id) AS BIGINT) AS n
  FROM dxc d JOIN c_sequel s ON d.person_id = s.person_id JOIN c_edge ON des = d.cid JOIN c_concept p ON p.id = anc
  WHERE p.name NOT IN ('General problem AND/OR complaint', 'Disease', 'Sequelae of disorders classified by disorder-system',
      'Sequela of disorder', 'Sequela', 'Recurrent disease', 'Problem', 'Acute disease', 'Chronic disease', 'Complication')
    AND lower(p.name) NOT LIKE '%right%' AND lower(p.name) NOT LIKE '%left%' AND lvl BETWEEN 0 AND 2
  GROUP BY ALL),
cand_either AS (
  SELECT * FROM cand WHERE NOT regexp_matches(lower(parent), 'finding|disorder of|by site')
    AND NOT regexp_matches(lower(child), 'finding|disorder of|by site')),
pairs AS (
  SELECT DISTINCT parent, child FROM cand_either
  WHERE parent IN (SELECT parent FROM cand_either GROUP BY 1 HAVING sum(n) >= 3)),
dxf AS (
  SELECT label, person_id, patient_group, CAST(sum(pre_n) AS BIGINT) AS pre_s, CAST(sum(post_n) AS BIGINT) AS post_s,
    CAST(sum(post_n) > sum(pre_n) AS INTEGER) AS greater_in_post,
    CAST(sum(pre_n) = 0 AND sum(post_n) > 0 AS INTEGER) AS only_in_post
  FROM (SELECT d.*, lower(regexp_replace(parent, '[^A-Za-z_0-9]', '_', 'g')) AS label
        FROM dxc d JOIN pairs ON child = cname
        WHERE parent <> 'EXCLUDE' AND lower(parent) NOT LIKE '%covid%' AND lower(parent) NOT LIKE '%coronav%')
  GROUP BY label, person_id, patient_group),
dxt AS (
  SELECT person_id, CAST(sum(pre_s) AS BIGINT) AS total_pre_dx, CAST(sum(post_s) AS BIGINT) AS total_post_dx FROM dxf GROUP BY 1),
medf AS (
  SELECT DISTINCT person_id, lower(regexp_replace(ing, '[^A-Za-z_0-9]', '_', 'g')) AS ingredient,
    CAST(CASE WHEN pre_n > 0 THEN 0 ELSE 1 END AS INTEGER) AS post_only_med FROM medc),
people AS (
  SELECT DISTINCT person_id, CASE WHEN lower(sex) IN ('unknown', 'gender unknown', 'no matching concept') THEN 'unknown' ELSE sex END AS sex,
    patient_group, apprx_age, race, ethn, tot_long_data_days, op_post_visit_ratio, ip_post_visit_ratio
  FROM (SELECT * EXCLUDE (cid, cname, pre_n, post_n) FROM dxc UNION ALL SELECT * EXCLUDE (ing_id, ing, pre_n, post_n) FROM medc)),
labelled AS (
  SELECT p.*, CAST(lc_date IS NOT NULL AS INTEGER) AS long_covid, CAST(patient_group = 'CASE_HOSP' AS INTEGER) AS hospitalized
  FROM people p LEFT JOIN c_sequel s ON p.person_id = s.person_id)
"""

_RESEARCH = """
sites AS (SELECT person_id, site FROM c_person),
r_dx AS (
  SELECT c.person_id, min(fdate) AS d FROM c_cond c JOIN sites s ON c.person_id = s.person_id
  WHERE cid = 37311061 AND site BETWEEN 0 AND 11 AND c.person_id IN (
    SELECT person_id FROM vmap WHERE kind IN (9203, 9201, 4207294, 262, 581379, 581385, 8717)) GROUP BY 1),
r_lab AS (
  SELECT m.person_id, min(fdate) AS d FROM c_meas m JOIN sites s ON m.person_id = s.person_id
  WHERE site BETWEEN 0 AND 11 AND result = 45884084
    AND mid IN (SELECT cid FROM c_set WHERE set_name = 'Brand#6' AND latest) GROUP BY 1),
r_idx AS (
  SELECT person_id, min(d) AS min_covid_dt FROM (SELECT * FROM r_dx UNION SELECT * FROM r_lab)
  WHERE person_id NOT IN (SELECT person_id FROM c_death) GROUP BY 1),
r_clinic AS (SELECT person_id, min(fdate) AS first_clinic FROM c_obs WHERE cid = 2004207791 GROUP BY 1),
r_comorb AS (
  SELECT s.nm, c.person_id, count(DISTINCT fdate) AS n, min(fdate) AS first_d FROM c_cond c
  JOIN (SELECT cid, CASE set_name WHEN 'Brand#1' THEN 'dm' WHEN 'Brand#2' THEN 'dm' WHEN 'Brand#3' THEN 'kid'
          WHEN 'Brand#4' THEN 'chf' ELSE 'pulm' END AS nm FROM c_set
        WHERE latest AND set_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')) s ON s.cid = c.cid
  GROUP BY ALL HAVING count(DISTINCT fdate) >= 2),
r_follow AS (
  SELECT i.person_id, min_covid_dt, gender, year_of_birth, race, ethn, p.site, CAST(run_date - min_covid_dt AS INTEGER) AS days
  FROM r_idx i JOIN c_person p USING (person_id) JOIN c_manifest m ON m.site = p.site
  WHERE run_date - min_covid_dt >= 90 AND year_of_birth <= 2003),
r_cohort AS (
  SELECT f.person_id, CAST(2021 - year_of_birth AS INTEGER) AS apprx_age, gender AS sex, race, ethn, site AS site_id, min_covid_dt,
    CASE WHEN dm.first_d < min_covid_dt THEN 'Yes' ELSE 'No' END AS diabetes_ind,
    CASE WHEN kid.first_d < min_covid_dt THEN 'Yes' ELSE 'No' END AS kidney_ind,
    CASE WHEN chf.first_d < min_covid_dt THEN 'Yes' ELSE 'No' END AS CHF_ind,
    CASE WHEN pulm.first_d < min_covid_dt THEN 'Yes' ELSE 'No' END AS ChronicPulm_ind
  FROM r_follow f
  LEFT JOIN (SELECT * FROM r_comorb WHERE nm = 'dm') dm ON dm.person_id = f.person_id
  LEFT JOIN (SELECT * FROM r_comorb WHERE nm = 'kid') kid ON kid.person_id = f.person_id
  LEFT JOIN (SELECT * FROM r_comorb WHERE nm = 'chf') chf ON chf.person_id = f.person_id
  LEFT JOIN (SELECT * FROM r_comorb WHERE nm = 'pulm') pulm ON pulm.person_id = f.person_id),
r_hosp AS (
  SELECT DISTINCT b.person_id FROM r_cohort b JOIN vmap v ON b.person_id = v.person_id
  WHERE mstart BETWEEN min_covid_dt - 14 AND min_covid_dt + 14
  UNION SELECT b.person_id FROM r_cohort b JOIN vmap v ON b.person_id = v.person_id JOIN c_cond c ON v.vid = c.fvisit
  WHERE v.mid IS NOT NULL AND cid = 37311061),
r_win AS (
  SELECT c.*, CASE WHEN c.person_id IN (SELECT person_id FROM r_hosp) THEN 'CASE_HOSP' ELSE 'CASE_NONHOSP' END AS patient_group,
    min_covid_dt - 365 AS pre_start, min_covid_dt - 45 AS pre_end, min_covid_dt + 45 AS post_start,
    CASE WHEN first_clinic < min_covid_dt + 45 THEN min_covid_dt + 45
      ELSE coalesce(first_clinic - 1, min_covid_dt + 365) END AS post_end,
    CASE WHEN first_clinic IS NOT NULL THEN 'TRAINING' ELSE 'TEST' END AS patient_type
  FROM r_cohort c LEFT JOIN r_clinic k ON k.person_id = c.person_id),
r_span AS (SELECT person_id, max(vstart) - min(vstart) AS days FROM vmap GROUP BY 1),
r_ftb AS (
  SELECT *, post_visits_count / nullif(tot_post_days, 0) AS post_visits_per_pt_day FROM (
    SELECT w.*, CAST(days AS INTEGER) AS tot_long_data_days, CAST(count(DISTINCT vstart) AS BIGINT) AS post_visits_count,
      CAST(post_end - post_start AS INTEGER) AS tot_post_days
    FROM r_win w JOIN r_span s ON w.person_id = s.person_id
    LEFT JOIN vmap v ON w.person_id = v.person_id AND vstart BETWEEN post_start AND post_end AND mid IS NULL
    WHERE days > 1 GROUP BY ALL)),
r_sum AS (
  SELECT person_id, apprx_age,
    CASE WHEN apprx_age BETWEEN 18 AND 35 THEN '18-35' WHEN apprx_age BETWEEN 36 AND 45 THEN '36-45'
      WHEN apprx_age BETWEEN 46 AND 55 THEN '46-55' WHEN apprx_age BETWEEN 56 AND 65 THEN '56-65'
      WHEN apprx_age >= 66 THEN '66+' ELSE 'unknown' END AS age_group,
    CASE race WHEN 'Chinese' THEN 'Asian' WHEN 'Black or African American' THEN 'Black' WHEN 'Other Race' THEN 'Other'
      WHEN 'No information' THEN 'Unknown' ELSE race END AS race_norm,
    CASE ethn WHEN 'No matching concept' THEN 'Unknown' ELSE ethn END AS ethn_norm,
    CASE sex WHEN 'No matching concept' THEN 'UNKNOWN' ELSE sex END AS sex_norm,
    diabetes_ind, kidney_ind, CHF_ind, ChronicPulm_ind, patient_group AS Hosp_ind,
    tot_long_data_days AS longitu_data_avail, post_visits_per_pt_day,
    CASE WHEN person_id IN (SELECT person_id FROM r_clinic) THEN '' ELSE 'NOT ' END || 'Long-COVID Clinic '
      || CASE patient_group WHEN 'CASE_HOSP' THEN 'HOSP' ELSE 'NONHOSP' END AS theGroup
  FROM r_ftb)
"""

_ROLLING = """
w AS (
  SELECT CAST(k AS INTEGER) AS wname, CAST(DATE '2020-01-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS wstart,
    CAST(DATE '2020-01-01' + to_months(CAST(k AS INTEGER)) AS DATE) + 100 AS wend FROM range(53) r(k)),
firsts AS (
  SELECT person_id, min(d) FILTER (WHERE pcr) AS pcr, min(d) FILTER (WHERE dx) AS dx, min(d) FILTER (WHERE lc) AS lc,
    min(d) FILTER (WHERE b94) AS b94, min(d) FILTER (WHERE pax OR (pax1 AND pax2)) AS pax, min(d) FILTER (WHERE rem) AS rem,
    min(d) FILTER (WHERE misc) AS misc
  FROM c_flag WHERE d >= DATE '2020-03-01' AND (pcr OR dx OR lc OR b94 OR pax OR (pax1 AND pax2) OR rem OR misc) GROUP BY 1),
ix AS (
  SELECT person_id, pcr AS pos_test_idx, dx AS u07_any_idx, least(pax, rem) AS pax_or_rem_idx,
    least(pcr, dx, pax, rem) AS idx FROM firsts WHERE least(pcr, dx, pax, rem) IS NOT NULL),
pos AS (SELECT DISTINCT person_id, d FROM c_flag WHERE pcr),
chain AS (
  SELECT person_id, least(pcr, dx) AS d, 0 AS n FROM firsts WHERE least(pcr, dx) IS NOT NULL
  UNION ALL
  SELECT c.person_id, min(p.d), n + 1 FROM chain c JOIN pos p ON p.person_id = c.person_id AND p.d - c.d > 60
  GROUP BY c.person_id, n),
black AS (
  SELECT DISTINCT person_id, d, d - 7 AS b, d + 28 AS e FROM (
    SELECT person_id, d FROM chain WHERE person_id IN (SELECT person_id FROM ix)
    UNION SELECT person_id, idx FROM ix)),
grid AS (
  SELECT p.person_id, gender AS sex, wname AS "window", CAST(year(wstart) - year_of_birth AS INTEGER) AS window_age
  FROM c_person p JOIN ix USING (person_id), w
  WHERE year(wstart) - year_of_birth >= 18 AND year(wstart) - year_of_birth < 100),
gp AS (SELECT person_id, count(*) AS nw FROM grid GROUP BY 1),
l_u AS (SELECT DISTINCT person_id, fdate FROM c_cond WHERE cid = 705076 AND fdate >= DATE '2020-02-01'),
l_b AS (SELECT DISTINCT person_id, fdate FROM c_cond WHERE cid = 36714927 AND fdate >= DATE '2020-02-01'),
l_c AS (SELECT DISTINCT person_id, fdate FROM c_obs WHERE cid = 2004207791),
lab_n AS (
  SELECT gp.person_id, nw, coalesce(u.n, 0) AS nu, u.d AS du, coalesce(b.n, 0) AS nb, b.d AS db, coalesce(c.n, 0) AS nc, c.d AS dc
  FROM gp LEFT JOIN (SELECT person_id, count(*) AS n, min(fdate) AS d FROM l_u GROUP BY 1) u ON u.person_id = gp.person_id
  LEFT JOIN (SELECT person_id, count(*) AS n, min(fdate) AS d FROM l_b GROUP BY 1) b ON b.person_id = gp.person_id
  LEFT JOIN (SELECT person_id, count(*) AS n, min(fdate) AS d FROM l_c GROUP BY 1) c ON c.person_id = gp.person_id),
lab AS (
  SELECT *, least(CASE WHEN nu >= 2 THEN du END, CASE WHEN nb >= 2 THEN db END, CASE WHEN nc >= 2 THEN dc END) AS label_date
  FROM lab_n WHERE nu >= 2 OR nb >= 2 OR nc >= 2),
pool_all AS (
  SELECT 'OBS-' || oid AS id, person_id, fdate, cid, cname FROM c_obs
  UNION ALL SELECT CAST(fact_id AS VARCHAR), person_id, fdate, cid, cname FROM c_cond),
pool AS (
  SELECT * FROM pool_all p WHERE person_id IN (SELECT person_id FROM grid)
    AND NOT EXISTS (SELECT 1 FROM black x WHERE x.person_id = p.person_id AND p.fdate BETWEEN x.b AND x.e)),
open_visit AS (
  SELECT * FROM c_visit v WHERE NOT EXISTS (
    SELECT 1 FROM black x WHERE x.person_id = v.person_id AND v.vstart BETWEEN x.b AND x.e)),
vc AS (
  SELECT g.person_id, g."window", CAST(count(DISTINCT CASE WHEN hosp IS NULL THEN vstart END) AS BIGINT) AS post_nonhosp_visit_count,
    CAST(count(DISTINCT CASE WHEN hosp = 1 THEN vstart END) AS BIGINT) AS post_hosp_count
  FROM grid g JOIN w ON g."window" = wname LEFT JOIN open_visit v ON v.person_id = g.person_id AND vstart BETWEEN wstart AND wend
  GROUP BY ALL),
fine AS (SELECT * FROM c_concept WHERE voc = 'SNOMED' AND dom IN ('Condition', 'Observation')),
ed AS (
  SELECT anc, des, lvl, a.name AS aname, d.name AS dname FROM c_edge JOIN fine a ON a.id = anc JOIN fine d ON d.id = des),
cc AS (SELECT cid, count(*) AS n FROM pool GROUP BY 1),
ac AS (SELECT anc, sum(n) AS total FROM ed JOIN cc ON cid = des GROUP BY 1),
cand_r AS (SELECT ed.*, n, total FROM ed JOIN ac USING (anc) JOIN cc ON cid = des WHERE total >= 500),
sel AS (
  SELECT * FROM cand_r c WHERE lvl = (SELECT min(lvl) FROM cand_r x WHERE x.des = c.des)
    AND des NOT IN (37311061, 36714927) AND anc NOT IN (37311061, 36714927)),
feat AS (
  SELECT DISTINCT g.person_id, g."window", anc AS concept_id FROM pool p JOIN sel ON des = p.cid
  JOIN w ON p.fdate BETWEEN wstart AND wend JOIN grid g ON g.person_id = p.person_id AND g."window" = wname),
wl AS (
  SELECT person_id, label_date, max(wname) AS "window" FROM lab JOIN w ON label_date BETWEEN wstart AND wend GROUP BY ALL),
others AS (SELECT * FROM grid WHERE person_id NOT IN (SELECT person_id FROM wl)),
tr AS (
  SELECT *, FALSE AS label FROM others
  WHERE CAST('0x' || substr(md5(person_id || '|' || "window" || '|42'), 1, 8) AS BIGINT) / 4294967296.0
    < least(1.0, (SELECT count(*) FROM wl) / nullif((SELECT count(*) FROM others), 0))
  UNION ALL
  SELECT g.*, TRUE FROM grid g JOIN wl ON wl.person_id = g.person_id AND wl."window" = g."window"),
tr_n AS (SELECT count(*) AS n, count(*) FILTER (WHERE label) AS n1 FROM tr),
cov AS (
  SELECT concept_id, count(*) AS seen, count(*) FILTER (WHERE label) AS seen1 FROM feat JOIN tr USING (person_id, "window") GROUP BY 1),
down AS (
  SELECT concept_id, (1 - seen / n) * (seen1 - seen * (n1 / n)) / n AS label_covariance, (seen1 - seen * (n1 / n)) / n AS true_covariance
  FROM cov, tr_n)
"""


def _sql(final: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in (_VIEWS, *parts)) + "\n" + final.strip()


def _day(**columns: str) -> str:
    """Dates as text under the given names."""
    return ", ".join(f"CAST({source} AS VARCHAR) AS {name}" for name, source in columns.items())


_EP = (_EPISODES,)
_AN = (_EPISODES, _ANCHORED)
_RE = (_EPISODES, _RESEARCH)
_RO = (_ROLLING,)

_MACRO = _day(macrovisit_start_date="mstart", macrovisit_end_date="mend")
_DEMO = "patient_group, apprx_age, sex, race, ethn, tot_long_data_days, op_post_visit_ratio, ip_post_visit_ratio"
_GROUPS = [f"group_{i}" for i in range(1, 26)]
_INGREDIENTS = [f"ingredient_{i}" for i in range(1, 26)]
_TYPES = [f"type_{i}" for i in range(1, 7)]


def _cells(table_value: str, key: str, names: list[str]) -> str:
    return ", ".join(f"CAST(coalesce(max({table_value}) FILTER (WHERE {key} = '{n}'), 0) AS INTEGER) AS {n}" for n in names)


_MATRIX = f"""
wide_dx AS (SELECT person_id, {_cells('greater_in_post', 'label', _GROUPS + _TYPES + _INGREDIENTS)} FROM dxf GROUP BY 1),
wide_med AS (SELECT person_id, {_cells('post_only_med', 'ingredient', _INGREDIENTS)} FROM medf GROUP BY 1),
matrix AS (
  SELECT l.person_id, long_covid, apprx_age, op_post_visit_ratio, ip_post_visit_ratio, hospitalized,
    CAST(sex = 'MALE' AS INTEGER) AS sex_male,
    {', '.join(f'coalesce({c}, 0) AS {c}' for c in _GROUPS + _TYPES)},
    {', '.join(f'greatest(coalesce(x.{c}, 0), coalesce(m.{c}, 0)) AS {c}' for c in _INGREDIENTS)},
    coalesce(total_pre_dx, 0) AS total_pre_dx, coalesce(total_post_dx, 0) AS total_post_dx, 0 AS never_seen
  FROM labelled l LEFT JOIN wide_dx x ON x.person_id = l.person_id LEFT JOIN wide_med m ON m.person_id = l.person_id
  LEFT JOIN dxt t ON t.person_id = l.person_id)
"""

_POOL_SAMPLE = """
draw AS (
  SELECT *, CAST('0x' || substr(md5(person_id || '|42'), 1, 8) AS BIGINT) / 4294967296.0 AS u,
    CAST('0x' || substr(md5(person_id || '|43'), 1, 8) AS BIGINT) / 4294967296.0 AS random FROM labelled),
spool AS (SELECT * FROM draw WHERE long_covid = 1 OR u < CASE WHEN hospitalized = 1 THEN 0.5 ELSE 0.25 END)
"""

_SCORES = """
sc AS (
  SELECT person_id, "window", person_id % 6 = 0 AS label,
    floor(CAST('0x' || substr(md5(person_id || '|' || "window" || '|7'), 1, 8) AS BIGINT) / 4294967296.0 * 1000) / 1000 AS s FROM grid),
pts AS (SELECT s, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM sc GROUP BY 1),
cum AS (
  SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn,
    sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM pts)
"""


def _or_columns(src: str) -> str:
    out = []
    for s, inside in (("total", "TRUE"), ("hosp", "hosp = 1"), ("nonhosp", "hosp = 0")):
        a = f"sum(x) FILTER (WHERE y = 1 AND {inside})"
        b = f"sum(n - x) FILTER (WHERE y = 1 AND {inside})"
        c = f"sum(x) FILTER (WHERE y = 0 AND {inside})"
        d = f"sum(n - x) FILTER (WHERE y = 0 AND {inside})"
        odds = f"({a} / nullif({b}, 0)) / nullif({c} / nullif({d}, 0), 0)"
        half = f"1.96 * sqrt(1 / nullif({a}, 0) + 1 / nullif({b}, 0) + 1 / nullif({c}, 0) + 1 / nullif({d}, 0))"
        log = f"ln(nullif({odds}, 0))"
        out.append(f"round({odds}, {{d}}) AS {s}_odds, round(exp({log} + {half}), {{d}}) AS {s}_upper_ci, "
                   f"round(exp({log} - {half}), {{d}}) AS {s}_lower_ci")
    return ", ".join(out)


_ODDS_LONG = """
odds_long AS (
  SELECT concept, y, hosp, CAST(count(*) AS DOUBLE) AS n, CAST(sum(v) AS DOUBLE) AS x FROM (
    """ + " UNION ALL ".join(
    f"SELECT '{c}' AS concept, long_covid AS y, hospitalized AS hosp, {c} AS v FROM matrix" for c in ["sex_male", *_GROUPS]) + """)
  GROUP BY ALL)
"""

_IMPORTANCES = """
imp AS (
  SELECT 'GROUP_' || substr(p_brand, 7) AS feature, CAST(sum(p_size) AS DOUBLE) AS total_imp,
    CAST(min(p_size) AS DOUBLE) AS nohosp_imp, CAST(max(p_size) AS DOUBLE) AS hosp_imp FROM part GROUP BY 1)
"""

_SUMMARY_CATEGORIES = ["sex_norm", "race_norm", "ethn_norm", "age_group", "diabetes_ind", "kidney_ind", "CHF_ind", "ChronicPulm_ind"]
_SUMMARY_NUMBERS = ["apprx_age", "post_visits_per_pt_day"]



def _wide(base: str, extra: str = "") -> str:
    return f"""
SELECT b.person_id, b."window", {extra} CAST(contains(lower(sex), 'female') AS BIGINT) AS is_female,
  CAST(floor(window_age / 10) AS BIGINT) AS age_bin,
  CAST(post_nonhosp_visit_count >= 2 AS BIGINT) + CAST(post_nonhosp_visit_count >= 10 AS BIGINT) AS op_visit_bin,
  CAST(post_hosp_count >= 2 AS BIGINT) + CAST(post_hosp_count >= 10 AS BIGINT) AS ip_visit_bin,
  coalesce(string_agg(CAST(concept_id AS VARCHAR), ',' ORDER BY concept_id), '') AS concepts
FROM {base} b JOIN vc ON vc.person_id = b.person_id AND vc."window" = b."window"
LEFT JOIN (SELECT * FROM feat WHERE concept_id IN (SELECT concept_id FROM down WHERE label_covariance > 0.00001)) f
  ON f.person_id = b.person_id AND f."window" = b."window"
GROUP BY ALL"""


ORACLES: dict[str, str] = {
    # ------------------------------------------------------------ visits and episodes
    "scaffold_filter": _sql(f"""SELECT vid AS visit_occurrence_id, person_id, kind AS visit_concept_id,
        {_day(visit_start_date='vstart', visit_end_date='vend')} FROM scaffold""", *_EP),
    "merge_intervals": _sql(f"SELECT person_id, g AS group_number, {_MACRO}, mid AS macrovisit_id FROM spans", *_EP),
    "map_visits_to_episodes": _sql(f"""SELECT vid AS visit_occurrence_id, person_id, {_day(visit_start_date='vstart')},
        mid AS macrovisit_id, {_MACRO} FROM vmap""", *_EP),
    "link_facts_to_episodes": _sql(f"""SELECT kind, fact_id, person_id, {_day(fact_date='fdate')}, fvisit AS visit_occurrence_id,
        mid AS macrovisit_id, {_MACRO} FROM (
          SELECT f.*, mid, mstart, mend FROM allf f JOIN vmap v ON v.vid = f.fvisit
          UNION
          SELECT f.*, mid, mstart, mend FROM allf f JOIN episodes e ON e.person_id = f.person_id
            AND fdate BETWEEN mstart AND mend WHERE fvisit IS NULL)""", *_EP, """
        allf AS (SELECT 'condition' AS kind, fact_id, person_id, fdate, fvisit FROM c_cond
          UNION ALL SELECT 'measurement', fact_id, person_id, fdate, fvisit FROM c_meas
          UNION ALL SELECT 'procedure', fact_id, person_id, fdate, fvisit FROM c_proc)"""),
    "episode_drilldown": _sql(f"""SELECT DISTINCT {_day(visit_start_date='vstart', visit_end_date='vend')},
        kind_name AS visit_concept_name, {_MACRO} FROM vmap WHERE person_id = 7 AND mid IS NOT NULL
        AND vstart BETWEEN DATE '2020-01-01' AND DATE '2026-12-31' ORDER BY 1""", *_EP),
    "calendar_windows": _sql(f"""SELECT wname AS window_name, {_day(window_start='wstart', window_end='wend')},
        count(vid) AS n_visits FROM w LEFT JOIN c_visit ON vstart BETWEEN wstart AND wend GROUP BY wname, wstart, wend""", *_RO),
    # ------------------------------------------------------------ code lists
    "concept_set_members": _sql("""SELECT set_name AS concept_set_name, cid AS concept_id, latest AS is_most_recent_version,
        dom AS domain_id FROM c_set JOIN c_concept ON id = cid WHERE set_name IN ('Brand#1', 'Brand#2', 'Brand#6') AND latest"""),
    "ingredient_concepts": _sql("""SELECT id AS concept_id, name AS concept_name, dom AS domain_id, voc AS vocabulary_id,
        cls AS concept_class_id, 'S' AS standard_concept FROM c_concept
        WHERE dom = 'Drug' AND lower(voc) = 'rxnorm' AND cls = 'Ingredient'"""),
    # ------------------------------------------------------------ index dates and cohort
    "first_event_dates": _sql(f"""SELECT person_id, {_day(pos_test_idx='pos_test_idx', u07_any_idx='u07_any_idx',
        u099_idx='u099_idx')} FROM idx""", *_AN),
    "site_index": _sql(f"""SELECT i.person_id, {_day(min_covid_dt='min_covid_dt', first_LC_clin_dt='first_clinic')}
        FROM r_idx i LEFT JOIN r_clinic c ON c.person_id = i.person_id""", *_RE),
    "earliest_index": _sql(f"""SELECT person_id, apprx_age, sex, race, ethn, site_id,
        {_day(min_covid_dt='min_covid_dt', run_date='run_date')} FROM base""", *_AN),
    "grouped_cohort": _sql(f"SELECT person_id, {_day(min_covid_dt='min_covid_dt')}, patient_group FROM grp", *_AN),
    "case_split": _sql("""SELECT person_id, CASE patient_group WHEN 'CASE_HOSP' THEN 'hosp' ELSE 'nonhosp' END AS part
        FROM grp""", *_AN),
    "pre_post_windows": _sql(f"""SELECT person_id, {_day(min_covid_dt='min_covid_dt', pre_window_start_dt='pre_start',
        pre_window_end_dt='pre_end', post_window_start_dt='post_start', post_window_end_dt='post_end')} FROM win""", *_AN),
    "visit_rates": _sql(f"""SELECT person_id, apprx_age, sex, race, ethn, site_id, {_day(min_covid_dt='min_covid_dt')}, patient_group,
        {_day(pre_window_start_dt='pre_start', pre_window_end_dt='pre_end', post_window_start_dt='post_start',
        post_window_end_dt='post_end')}, CAST(tot_long_data_days AS INTEGER) AS tot_long_data_days, post_visits_count,
        CAST(tot_post_days AS INTEGER) AS tot_post_days, op_ratio AS post_visits_per_pt_day FROM ftb""", *_AN),
    "comorbidity_flags": _sql(f"""SELECT person_id, apprx_age, sex, race, ethn, site_id, {_day(min_covid_dt='min_covid_dt')},
        diabetes_ind, kidney_ind, CHF_ind, ChronicPulm_ind FROM r_cohort""", *_RE),
    "comorbidity_patients": _sql(f"""SELECT person_id, count(DISTINCT fdate) AS dx_count, {_day(earliest_dx='min(fdate)')}
        FROM c_cond WHERE cid IN (SELECT cid FROM c_set WHERE latest AND set_name IN ('Brand#1', 'Brand#2'))
        GROUP BY 1 HAVING count(DISTINCT fdate) >= 2"""),
    "history_filter": _sql(f"""SELECT person_id, {_day(min_covid_dt='min_covid_dt', run_date='run_date', min_visit_dt='mv')},
        CAST(run_date - mv AS INTEGER) AS HX_DAYS FROM (
          SELECT i.person_id, min_covid_dt, run_date, min(vstart) AS mv FROM r_idx i JOIN c_visit v ON v.person_id = i.person_id
          JOIN sites s ON s.person_id = v.person_id JOIN c_manifest m ON m.site = s.site JOIN c_cond c ON c.fvisit = v.vid
          GROUP BY ALL) WHERE min_covid_dt - mv >= run_date - min_covid_dt OR min_covid_dt - mv >= 180""", *_RE),
    "follow_up_filter": _sql(f"""SELECT person_id, {_day(min_covid_dt='min_covid_dt')}, gender AS gender_concept_name, year_of_birth,
        race AS race_concept_name, ethn AS ethnicity_concept_name, site AS data_partner_id, days AS days_since_covid
        FROM r_follow""", *_RE),
    "research_features": _sql(f"""SELECT person_id, apprx_age, sex, race, ethn, site_id, {_day(min_covid_dt='min_covid_dt')},
        diabetes_ind, kidney_ind, CHF_ind, ChronicPulm_ind, patient_group, {_day(pre_window_start_dt='pre_start',
        pre_window_end_dt='pre_end', post_window_start_dt='post_start', post_window_end_dt='post_end')}, patient_type,
        tot_long_data_days, post_visits_count, tot_post_days, post_visits_per_pt_day FROM r_ftb""", *_RE),
    "flagged_split": _sql("""SELECT person_id, CASE WHEN person_id IN (SELECT person_id FROM r_clinic) THEN 'flagged'
        ELSE 'other' END AS part FROM r_ftb""", *_RE),
    "normalise_groups": _sql("SELECT * FROM r_sum", *_RE),
    "training_prevalence": _sql("""SELECT cid AS condition_concept_id, cname AS condition_concept_name,
        count(DISTINCT f.person_id) AS dxct FROM r_ftb f JOIN c_cond c ON c.person_id = f.person_id
        AND fdate BETWEEN post_start AND post_end JOIN vmap ON vid = fvisit WHERE patient_type = 'TRAINING' GROUP BY ALL""", *_RE),
    "check_counts": _sql("""SELECT count(DISTINCT cname) AS n, 'conditions' AS what FROM dxc
        UNION ALL SELECT count(DISTINCT person_id), 'persons' FROM ftb
        UNION ALL SELECT count(*), patient_group FROM ftb GROUP BY patient_group""", *_AN),
    # ------------------------------------------------------------ windowed counts
    "ingredient_rollup": _sql(f"""SELECT person_id, {_day(drug_exposure_start_date='fdate')}, fvisit AS visit_occurrence_id,
        did AS original_drug_concept_id, dname AS original_drug_concept_name, ing_id AS ancestor_drug_concept_id,
        ing AS ancestor_drug_concept_name FROM roll""", *_AN),
    "pre_post_counts": _sql(f"""SELECT person_id, cid AS condition_concept_id, cname AS condition_concept_name,
        pre_n AS pre_dx_count, post_n AS post_dx_count, {_DEMO} FROM dxc""", *_AN),
    "pre_post_med_counts": _sql(f"""SELECT person_id, ing_id AS ancestor_drug_concept_id, ing AS ancestor_drug_concept_name,
        pre_n AS pre_med_count, post_n AS post_med_count, {_DEMO} FROM medc""", *_AN),
    "inpatient_days": _sql(f"""SELECT person_id, {_day(post_window_start_dt='post_start', post_window_end_dt='post_end')},
        tot_ip_days FROM ipd""", *_AN),
    "pre_post_labs": _sql("""SELECT person_id, set_name AS concept_set_name,
        coalesce(min(val) FILTER (WHERE is_pre), -999) AS pre_min_val, coalesce(min(val) FILTER (WHERE NOT is_pre), -999) AS post_min_val,
        coalesce(max(val) FILTER (WHERE is_pre), -999) AS pre_max_val, coalesce(max(val) FILTER (WHERE NOT is_pre), -999) AS post_max_val,
        round(coalesce(avg(val) FILTER (WHERE is_pre), -999), 6) AS pre_avg_val,
        round(coalesce(avg(val) FILTER (WHERE NOT is_pre), -999), 6) AS post_avg_val
        FROM (SELECT DISTINCT f.person_id, set_name, fdate, fvisit, val, unit, fdate BETWEEN pre_start AND pre_end AS is_pre
              FROM ftb f JOIN c_meas m ON m.person_id = f.person_id JOIN c_set ON cid = mid AND latest
              WHERE fdate BETWEEN pre_start AND pre_end OR fdate BETWEEN post_start AND post_end) GROUP BY ALL""", *_AN),
    "lab_population": _sql("""SELECT set_name AS concept_set_name, unit AS harmonized_unit_concept_id, round(avg(val), 6) AS pop_avg,
        round(stddev_samp(val), 6) AS stddev FROM ftb f JOIN c_meas m ON m.person_id = f.person_id
        JOIN c_set ON cid = mid AND latest WHERE val IS NOT NULL GROUP BY ALL""", *_AN),
    "prevalence": _sql("""SELECT cid AS condition_concept_id, cname AS condition_concept_name, count(DISTINCT person_id) AS pt_count
        FROM dxc GROUP BY ALL HAVING count(DISTINCT person_id) >= (SELECT count(DISTINCT person_id) FROM dxc) * 0.01""", *_AN),
    "post_only_flags": _sql("""SELECT person_id, ing_id AS ancestor_drug_concept_id, pre_n AS pre_med_count, post_n AS post_med_count,
        CASE WHEN pre_n > 0 THEN 0 ELSE 1 END AS post_only_med, CASE WHEN pre_n < post_n THEN 1 ELSE 0 END AS more_in_post
        FROM medc WHERE ing_id IN (SELECT ing_id FROM medc GROUP BY 1
          HAVING count(DISTINCT person_id) >= (SELECT count(DISTINCT person_id) FROM medc) * 0.01)""", *_AN),
    "med_flags": _sql("SELECT * FROM medf", *_AN),
    # ------------------------------------------------------------ features
    "one_hot": _sql("""SELECT person_id, patient_group, apprx_age, tot_long_data_days, op_post_visit_ratio, ip_post_visit_ratio,
        CAST(sex = 'FEMALE' AS INTEGER) AS sex_female, CAST(sex = 'MALE' AS INTEGER) AS sex_male,
        CAST(sex = 'unknown' AS INTEGER) AS sex_unknown,
        CAST(race = 'Black or African American' AS INTEGER) AS race_black_or_african_american,
        CAST(race = 'Chinese' AS INTEGER) AS race_chinese, CAST(race = 'No information' AS INTEGER) AS race_no_information,
        CAST(race = 'Other Race' AS INTEGER) AS race_other_race, CAST(race = 'White' AS INTEGER) AS race_white,
        CAST(ethn = 'Hispanic or Latino' AS INTEGER) AS ethn_hispanic_or_latino,
        CAST(ethn = 'No matching concept' AS INTEGER) AS ethn_no_matching_concept,
        CAST(ethn = 'Not Hispanic or Latino' AS INTEGER) AS ethn_not_hispanic_or_latino, long_covid, hospitalized
        FROM labelled""", *_AN),
    "rollup_candidates": _sql("""SELECT parent AS parent_concept_name, child AS child_concept_name, child_id AS child_concept_id,
        lvl AS min_hops_bt_parent_child, lvl AS max_hops_bt_parent_child, n AS ptct_training FROM cand_either""", *_AN),
    "rollup_candidates_parent_rule": _sql("""SELECT parent AS parent_concept_name, child AS child_concept_name,
        child_id AS child_concept_id, lvl AS min_hops_bt_parent_child, lvl AS max_hops_bt_parent_child, n AS ptct_training FROM cand
        WHERE (lower(parent) NOT LIKE '%finding%' OR lower(child) LIKE '%finding%')
          AND (lower(parent) NOT LIKE '%disorder of%' OR lower(child) LIKE '%disorder of%')
          AND (lower(parent) NOT LIKE '%by site%' OR lower(child) LIKE '%by site%')""", *_AN),
    "final_rollup": _sql("SELECT parent AS parent_concept_name, child AS child_concept_name FROM pairs", *_AN),
    "apply_rollup": _sql("""SELECT label AS high_level_condition, person_id, patient_group, pre_s AS pre_dx_count_sum,
        post_s AS post_dx_count_sum, greater_in_post, only_in_post FROM dxf""", *_AN),
    "apply_label_map": _sql("""SELECT lower(p_type) AS high_level_condition, person_id, patient_group,
        CAST(sum(pre_n) AS BIGINT) AS pre_dx_count_sum, CAST(sum(post_n) AS BIGINT) AS post_dx_count_sum,
        CAST(sum(post_n) > sum(pre_n) AS INTEGER) AS greater_in_post,
        CAST(sum(pre_n) = 0 AND sum(post_n) > 0 AS INTEGER) AS only_in_post
        FROM dxc JOIN part ON cname = 'part ' || p_partkey WHERE p_type <> 'PROMO' GROUP BY ALL""", *_AN),
    "dx_totals": _sql("SELECT * FROM dxt", *_AN),
    "pivot_features": _sql(f"""SELECT * FROM (SELECT person_id, {_cells('greater_in_post', 'label', _GROUPS)} FROM dxf
        WHERE label IN ({', '.join(repr(g) for g in _GROUPS)}) GROUP BY 1)
        JOIN (SELECT person_id, {_cells('post_only_med', 'ingredient', _INGREDIENTS)} FROM medf GROUP BY 1) USING (person_id)""", *_AN),
    "pivot_cases": _sql("SELECT person_id, patient_group, " + ", ".join(
        f"CAST(coalesce(max({v}) FILTER (WHERE label = 'group_{i}'), 0) AS INTEGER) AS group_{i}_{v}"
        for i in range(1, 26) for v in ("greater_in_post", "only_in_post"))
        + f" FROM dxf WHERE label IN ({', '.join(repr(g) for g in _GROUPS)}) GROUP BY ALL", *_AN),
    "aligned_matrix": _sql("SELECT * FROM matrix", *_AN, _MATRIX),
    "label_checks": _sql("""SELECT DISTINCT p.person_id, coalesce(d.patient_group, 'absent') AS patient_group
        FROM c_person p LEFT JOIN dxc d ON d.person_id = p.person_id WHERE p.person_id % 6 = 0""", *_AN),
    "date_placeholder": _sql("""SELECT p.person_id, coalesce(CAST(lc_date AS VARCHAR), '0000-00-00') AS min_long_covid_date
        FROM c_person p LEFT JOIN c_sequel s ON s.person_id = p.person_id"""),
    "drug_features": _sql("""SELECT DISTINCT person_id, ing AS ingredient, CASE WHEN pre_n > 0 THEN 0 ELSE 1 END AS post_only_med
        FROM medc""", *_AN),
    "regression_input": _sql("""SELECT CASE WHEN apprx_age BETWEEN 18 AND 25 THEN '18-25' WHEN apprx_age BETWEEN 26 AND 45 THEN '26-45'
        WHEN apprx_age BETWEEN 46 AND 55 THEN '46-55' WHEN apprx_age BETWEEN 56 AND 65 THEN '56-65' WHEN apprx_age >= 66 THEN '66+'
        ELSE 'unknown' END AS apprx_age, op_post_visit_ratio, long_covid, hospitalized, count(*) AS n,
        round(sum(ip_post_visit_ratio), 6) AS ip_sum FROM labelled GROUP BY 1, 2, 3, 4""", *_AN),
    "fixed_cutoff_cohort": _sql(f"""SELECT DISTINCT i.person_id, CAST(2022 - year_of_birth AS INTEGER) AS apprx_age, gender AS sex, race,
        ethn, p.site AS site_id, {_day(min_covid_dt='least(pos_test_idx, u07_any_idx)', run_date="DATE '2022-06-22'")}
        FROM idx i JOIN c_person p USING (person_id) LEFT JOIN c_death d ON d.person_id = i.person_id
        WHERE DATE '2022-06-22' - least(pos_test_idx, u07_any_idx, death_date) >= 100""", *_AN),
    "demographic_features": _sql("SELECT DISTINCT person_id, apprx_age, sex, race, ethn FROM dxc", *_AN),
    # ------------------------------------------------------------ rolling windows
    "index_dates": _sql(f"""SELECT f.person_id, {_day(COVID_first_PCR_or_AG_lab_positive='pcr', COVID_first_diagnosis_date='dx',
        Long_COVID_first_diagnosis_date='lc', B94_8_first_diagnosis_date='b94', first_pax_date='pax', first_rem_date='rem',
        MISC_first_diagnosis_date='misc', COVID_first_poslab_or_diagnosis_date='least(pcr, dx)',
        pax_or_rem_idx='pax_or_rem_idx', covid_index_date='idx')} FROM firsts f LEFT JOIN ix ON ix.person_id = f.person_id""", *_RO),
    "greedy_chain": _sql(f"SELECT person_id, {_day(infection_date='d')}, CAST(n AS INTEGER) AS infection_number FROM chain", *_RO),
    "greedy_chain_as_coded": _sql(f"""SELECT person_id, {_day(infection_date='d')}, CAST(n AS INTEGER) AS infection_number FROM chain
        UNION ALL SELECT person_id, NULL, 0 FROM firsts WHERE pcr IS NULL AND dx IS NULL""", *_RO),
    "blackout_spans": _sql(f"""SELECT person_id, {_day(infection_date='d', blackout_begin='b', blackout_end='e')} FROM black""", *_RO),
    "person_window_grid": _sql("SELECT * FROM grid", *_RO),
    "repeat_labels": _sql(f"""SELECT person_id, nu AS num_u09s, {_day(min_u09_date='du')}, nb AS num_b948s, {_day(min_b948_date='db')},
        nc AS TRAIN_num_lc_clinic_visits, {_day(TRAIN_min_lc_clinic_date='dc')}, TRUE AS label, {_day(label_date='label_date')}
        FROM lab""", *_RO),
    "repeat_labels_as_coded": _sql(f"""SELECT person_id, num_u09s, {_day(min_u09_date='du')}, num_b948s, {_day(min_b948_date='db')},
        visits AS TRAIN_num_lc_clinic_visits, {_day(TRAIN_min_lc_clinic_date='dc')}, TRUE AS label,
        CAST(CASE WHEN visits >= 2 THEN dc ELSE du END AS VARCHAR) AS label_date FROM (
          SELECT x.*, coalesce(y.visits, 0) AS visits, y.dc FROM (
            SELECT g.person_id, count(u.fdate) AS num_u09s, min(u.fdate) AS du, count(b.fdate) AS num_b948s, min(b.fdate) AS db
            FROM grid g LEFT JOIN l_u u ON u.person_id = g.person_id LEFT JOIN l_b b ON b.person_id = g.person_id GROUP BY 1) x
          LEFT JOIN (SELECT g.person_id, count(*) AS visits, min(fdate) AS dc FROM grid g JOIN l_c c ON c.person_id = g.person_id
            GROUP BY 1) y ON y.person_id = x.person_id)
        WHERE visits >= 2 OR num_u09s >= 2""", *_RO),
    "blackout_anti_join": _sql(f"""SELECT id AS condition_occurrence_id, person_id, {_day(condition_start_date='fdate')},
        cid AS condition_concept_id, cname AS condition_concept_name FROM pool""", *_RO),
    "blackout_anti_join_all": _sql(f"""SELECT id AS condition_occurrence_id, person_id, {_day(condition_start_date='fdate')},
        cid AS condition_concept_id, cname AS condition_concept_name FROM pool_all p
        WHERE NOT EXISTS (SELECT 1 FROM black x WHERE x.person_id = p.person_id AND p.fdate BETWEEN x.b AND x.e)""", *_RO),
    "window_visit_counts": _sql("SELECT * FROM vc", *_RO),
    "pool_facts": _sql(f"""SELECT id AS condition_occurrence_id, person_id, {_day(condition_start_date='fdate')},
        cid AS condition_concept_id, cname AS condition_concept_name FROM pool_all""", *_RO),
    "closure_counts": _sql("""SELECT anc AS ancestor_concept_id, CAST(sum(n) AS BIGINT) AS ancestor_count FROM ed
        JOIN (SELECT cid, count(*) AS n FROM pool_all GROUP BY 1) ON cid = des GROUP BY 1""", *_RO),
    "select_ancestors": _sql("""SELECT anc AS ancestor_concept_id, des AS descendant_concept_id, dname AS des_concept_name,
        aname AS anc_concept_name, lvl AS min_levels_of_separation, n AS descendant_count, CAST(total AS BIGINT) AS ancestor_count
        FROM cand_r c WHERE lvl = (SELECT min(lvl) FROM cand_r x WHERE x.des = c.des)
          AND des NOT IN (SELECT id FROM blk) AND anc NOT IN (SELECT id FROM blk)""", *_RO, """
        blk AS (SELECT DISTINCT des AS id FROM c_edge WHERE anc IN (20000004) OR des IN (10000003, 17))"""),
    "window_features": _sql("SELECT * FROM feat", *_RO),
    "windowed_labels": _sql(f"""SELECT person_id, TRUE AS label, {_day(label_date='label_date')}, "window" FROM wl""", *_RO),
    "balanced_sample": _sql("SELECT * FROM tr", *_RO),
    "covariance_select": _sql("""SELECT DISTINCT concept_id, round(label_covariance, 8) AS label_covariance,
        round(true_covariance, 8) AS true_covariance, aname AS concept_name FROM down JOIN sel ON anc = concept_id
        WHERE label_covariance > 0.00001""", *_RO),
    "training_matrix": _sql(_wide("tr", """label, CAST('0x' || substr(md5(b.person_id || '|' || b."window" || '|1234'), 1, 8) AS BIGINT)
        / 4294967296.0 < 0.05 AS hold_for_val,"""), *_RO),
    "scoring_matrix": _sql(_wide("grid"), *_RO),
    # ------------------------------------------------------------ samples
    "class_sample": _sql("SELECT person_id, long_covid, hospitalized, round(random, 9) AS random FROM spool", *_AN, _POOL_SAMPLE),
    "hash_split": _sql("SELECT person_id, CASE WHEN random <= 0.77 THEN 'train' ELSE 'test' END AS part FROM spool", *_AN, _POOL_SAMPLE),
    "class_balance": _sql("SELECT long_covid, hospitalized, count(*) AS num_patients FROM labelled GROUP BY ALL", *_AN),
    # ------------------------------------------------------------ evaluation
    "best_window": _sql("""SELECT person_id, max(s) AS max_score, arg_max("window", (s, -"window")) AS "window" FROM sc GROUP BY 1""",
                        *_RO, _SCORES),
    "roc_table": _sql("""SELECT round(cn / nullif(tn, 0), 9) AS FPR, round(cp / nullif(tp, 0), 9) AS TPR, s AS threshold FROM cum
        UNION ALL SELECT 0.0, 0.0, NULL""", *_RO, _SCORES),
    "roc_area": _sql("SELECT round(sum(n * (cp - p + p / 2)) / (sum(p) * sum(n)), 9) AS auc FROM cum", *_RO, _SCORES),
    "odds_2x2": _sql("SELECT concept, " + _or_columns("odds_long").replace("{d}", "6") + " FROM odds_long GROUP BY 1",
                     *_AN, _MATRIX, _ODDS_LONG),
    "top_features": _sql("SELECT * FROM imp WHERE hosp_imp >= (SELECT min(h) FROM (SELECT hosp_imp AS h FROM imp ORDER BY 1 DESC LIMIT 23))",
                         _IMPORTANCES),
    "table_one": _sql("SELECT grp, variable, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY grp, variable), 6) AS pct, "
                      "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd FROM ("
                      + " UNION ALL ".join(f"SELECT theGroup AS grp, '{c}' AS variable, {c} AS value, count(*) AS n FROM r_sum GROUP BY ALL"
                                           for c in _SUMMARY_CATEGORIES) + ")"
                      + "".join(f" UNION ALL SELECT theGroup, '{c}', NULL, count({c}), NULL, round(avg({c}), 6), round(stddev_samp({c}), 6)"
                                f" FROM r_sum GROUP BY theGroup" for c in _SUMMARY_NUMBERS), *_RE),
}

# quantiles take constant fractions, so each is a SELECT of its own
ORACLES["age_quantiles"] = _sql(" UNION ALL ".join(
    f"SELECT CAST({q} AS DOUBLE) AS probability, round(quantile_cont(CAST(apprx_age AS DOUBLE), {q}), 6) AS age FROM r_sum "
    "WHERE theGroup IN ('Long-COVID Clinic HOSP', 'Long-COVID Clinic NONHOSP')" for q in (0.01, 0.25, 0.5, 0.85, 1.0)), *_RE)
ORACLES["group_variance"] = _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, "
    "round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_value FROM ("
    "SELECT count(*) AS k, sum(gn) AS n, sum(gn * (gm - grand) ** 2) AS ssb, sum(gss) AS ssw FROM ("
    f"SELECT theGroup, count({c}) AS gn, avg({c}) AS gm, var_pop({c}) * count({c}) AS gss FROM r_sum "
    f"WHERE {c} IS NOT NULL GROUP BY 1), "
    f"(SELECT avg({c}) AS grand FROM r_sum))" for c in _SUMMARY_NUMBERS), *_RE)

def _simpson(density: str, low: str, high: str, parts: int = 20000) -> str:
    """The integral of a density in u, as an aggregate over one row's columns."""
    return (f"(SELECT sum(CASE WHEN i IN (0, {parts}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({density})) * ({high} - {low}) / {3 * parts} "
            f"FROM (SELECT i, {low} + ({high} - {low}) * i / {parts} AS u FROM range({parts + 1}) t(i)))")


# Tails by Simpson's rule: chi-square over u = sqrt(x), F over the angle whose squared sine is the beta variable.
_CHI_TAIL = _simpson("exp(ln(2) + (df - 1) * ln(greatest(u, 1e-300)) - u * u / 2 - df / 2.0 * ln(2) - lgamma(df / 2.0))",
                     "sqrt(statistic)", "(sqrt(statistic) + sqrt(df) + 12)")
_F_TAIL = _simpson("2 * exp((df - 1) * ln(greatest(sin(u), 1e-300)) + (dw - 1) * ln(greatest(cos(u), 1e-300)) - lb)",
                   "low", "least(pi() / 2, low + 40 / sqrt(dw))")
ORACLES["table_one_tests"] = _sql(
    f"SELECT variable, test, round(statistic, 5) AS statistic, df, round({_CHI_TAIL}, 6) AS p_value FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, 'chi-square' AS test, greatest(max(total) * (sum(o * o / (CAST(row_n AS DOUBLE) * col_n)) - 1), 0) AS statistic, "
        "(count(DISTINCT g) - 1) * (count(DISTINCT v) - 1) AS df FROM ("
        "SELECT *, sum(o) OVER (PARTITION BY g) AS row_n, sum(o) OVER (PARTITION BY v) AS col_n, sum(o) OVER () AS total FROM ("
        f"SELECT theGroup AS g, coalesce(CAST({c} AS VARCHAR), 'none') AS v, count(*) AS o FROM r_sum GROUP BY ALL))"
        for c in _SUMMARY_CATEGORIES)
    + f") UNION ALL SELECT variable, 'anova', round(statistic, 5), df, round({_F_TAIL}, 6) FROM ("
    "SELECT *, asin(sqrt(df * statistic / (dw + df * statistic))) AS low, lgamma(df / 2.0) + lgamma(dw / 2.0) - lgamma((df + dw) / 2.0) AS lb FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, (ssb / (k - 1)) / (ssw / (n - k)) AS statistic, k - 1 AS df, n - k AS dw FROM ("
        "SELECT count(*) AS k, sum(gn) AS n, sum(gn * (gm - grand) ** 2) AS ssb, sum(gss) AS ssw FROM ("
        f"SELECT theGroup, count({c}) AS gn, avg({c}) AS gm, var_pop({c}) * count({c}) AS gss FROM r_sum "
        f"WHERE {c} IS NOT NULL GROUP BY 1), (SELECT avg({c}) AS grand FROM r_sum))" for c in _SUMMARY_NUMBERS) + "))", *_RE)
ORACLES["gbt_scores"] = _sql('SELECT person_id, "window", TRUE AS is_probability, TRUE AS auc_over_bound FROM grid', *_RO)
ORACLES["forest_importance"] = _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, TRUE AS not_negative, TRUE AS sums_to_one, CASE WHEN min({c}) = max({c}) THEN TRUE END AS constant_has_none FROM matrix"
    for c in ["apprx_age", "op_post_visit_ratio", "ip_post_visit_ratio", "hospitalized", "sex_male", *_GROUPS, *_TYPES, *_INGREDIENTS,
              "total_pre_dx", "total_post_dx", "never_seen"]), *_AN, _MATRIX)
ORACLES["vocabulary_files"] = _sql("""SELECT anc AS ancestor_concept_id, des AS descendant_concept_id, lvl AS min_levels_of_separation,
    name AS concept_name, dom AS domain_id, voc AS vocabulary_id, cls AS concept_class_id, 'S' AS standard_concept
    FROM c_edge JOIN c_concept ON id = anc""")
ORACLES["feature_list_file"] = _sql("SELECT name AS feature FROM c_concept WHERE cls = 'Group'")
ORACLES["roc_table_any_scores"] = _sql("""SELECT round(cn / nullif(tn, 0), 9) AS FPR, round(cp / nullif(tp, 0), 9) AS TPR, s AS threshold
    FROM any_cum UNION ALL SELECT 0.0, 0.0, NULL""", *_RO, _SCORES, """
any_pts AS (SELECT s * 20 - 7 AS s, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM sc
  WHERE person_id % 11 <> 0 GROUP BY 1),
any_cum AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn,
    sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM any_pts)""")

# Other ways to the same result.
ORACLES |= {f"{name}_by_person": ORACLES[name] for name in ("blackout_anti_join", "pre_post_counts")}


def _sums(points: str) -> str:
    """Log-likelihood, gradient and weights' moments of one-predictor logistic models at points (model, side, a, b)."""
    eta, p = "(a + b * x)", "(1 / (1 + exp(-(a + b * x))))"
    return (f"SELECT model, side, a, b, sum(y * {eta} - n * (greatest({eta}, 0) + ln(1 + exp(-abs({eta}))))) AS ll, sum(y - n * {p}) AS g0, "
            f"sum((y - n * {p}) * x) AS g1, sum(n * {p} * (1 - {p})) AS s0, sum(n * {p} * (1 - {p}) * x) AS s1, "
            f"sum(n * {p} * (1 - {p}) * x * x) AS s2 FROM lg JOIN {points} USING (model) GROUP BY ALL")


_BANDS = [("26-45", 26, 45), ("46-55", 46, 55), ("56-65", 56, 65), ("66+", 66, 999)]
_ROUNDS = 14
_LOGIT = ["""
lg AS MATERIALIZED (
  SELECT stratum || '|' || predictor AS model, x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS y FROM (
    SELECT unnest(['total', CASE WHEN hospitalized = 1 THEN 'hosp' ELSE 'nonhosp' END]) AS stratum, predictor, x, y FROM (
""" + " UNION ALL ".join(
    [f"SELECT hospitalized, long_covid AS y, 'Age ({b})' AS predictor, CASE WHEN apprx_age BETWEEN {lo} AND {hi} THEN 1.0::DOUBLE "
     "WHEN apprx_age BETWEEN 18 AND 25 THEN 0.0::DOUBLE END AS x FROM matrix" for b, lo, hi in _BANDS]
    + [f"SELECT hospitalized, long_covid, '{c}', CAST({c} AS DOUBLE) * 10 FROM matrix" for c in ("op_post_visit_ratio", "ip_post_visit_ratio")])
    + """)) WHERE x IS NOT NULL GROUP BY ALL),
f0 AS (
  SELECT model, 'fit' AS side, ln(sum(y) / (sum(n) - sum(y))) AS a, 0.0::DOUBLE AS b FROM lg GROUP BY model
  HAVING sum(y) > 0 AND sum(y) < sum(n) AND max(x) FILTER (n > y) > min(x) FILTER (y > 0)
    AND max(x) FILTER (y > 0) > min(x) FILTER (n > y))"""]
for _k in range(_ROUNDS):
    _LOGIT.append(f"""
f{_k + 1} AS MATERIALIZED (SELECT model, side, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1) AS a, b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) AS b
  FROM ({_sums(f'f{_k}')}))""")
_LOGIT.append(f"""
best AS MATERIALIZED ({_sums(f'f{_ROUNDS}')}),
l0 AS (
  SELECT model, name AS side, a - z * s1 / s0 AS a, b + z AS b FROM (
    SELECT *, d * 1.959963984540054 * sqrt(s0 / (s0 * s2 - s1 * s1)) AS z FROM best, (VALUES ('upper', 1), ('lower', -1)) v(name, d)))""")
for _k in range(_ROUNDS):
    _LOGIT.append(f"""
l{_k + 1} AS MATERIALIZED (
  SELECT model, side, a - (g1 * g0 + s1 * miss) / (s1 * g0 - s0 * g1) AS a, b + (g0 * g0 + s0 * miss) / (s1 * g0 - s0 * g1) AS b
  FROM (SELECT q.*, q.ll - best.ll + 1.920729410347062 AS miss FROM ({_sums(f'l{_k}')}) q JOIN best USING (model)))""")
_LOGIT.append(f"ends AS (SELECT model, side, exp(b) AS e FROM f{_ROUNDS} UNION ALL SELECT model, side, exp(b) FROM l{_ROUNDS})")
ORACLES["logistic_odds"] = _sql("SELECT concept, subgroup, " + ", ".join(
    f"round(max(e) FILTER (model = '{s}|' || subgroup AND side = '{side}'), 4) AS {s}_{column}"
    for s in ("total", "hosp", "nonhosp") for column, side in (("odds", "fit"), ("upper_ci", "upper"), ("lower_ci", "lower")))
    + " FROM (VALUES " + ", ".join([f"('apprx_age', 'Age ({b})')" for b, _, _ in _BANDS]
                                   + [f"('{c}', '{c}')" for c in ("op_post_visit_ratio", "ip_post_visit_ratio")])
    + ") t(concept, subgroup), (SELECT * FROM ends UNION ALL SELECT NULL, NULL, NULL) GROUP BY ALL", *_AN, _MATRIX, ",".join(_LOGIT))
ORACLES["odds_with_importance"] = _sql("""SELECT o.*, imp.* FROM (SELECT concept, concept AS subgroup, """
    + _or_columns("odds_long").replace("{d}", "3") + " FROM odds_long GROUP BY 1 UNION ALL SELECT concept, subgroup, " + ", ".join(
        f"round(max(e) FILTER (model = '{s}|' || subgroup AND side = '{side}'), 3) AS {s}_{column}"
        for s in ("total", "hosp", "nonhosp") for column, side in (("odds", "fit"), ("upper_ci", "upper"), ("lower_ci", "lower")))
    + " FROM (VALUES " + ", ".join([f"('apprx_age', 'Age ({b})')" for b, _, _ in _BANDS]
                                   + [f"('{c}', '{c}')" for c in ("op_post_visit_ratio", "ip_post_visit_ratio")])
    + """) t(concept, subgroup), (SELECT * FROM ends UNION ALL SELECT NULL, NULL, NULL) GROUP BY ALL) o
    LEFT JOIN imp ON lower(concept) = lower(feature)""", *_AN, _MATRIX, _ODDS_LONG, _IMPORTANCES, ",".join(_LOGIT))
ORACLES["one_hot_discovered"] = _sql(" UNION ALL ".join(
    f"SELECT person_id, lower(replace('{c}_' || v, ' ', '_')) AS name, CAST(coalesce(tidy = v, FALSE) AS INTEGER) AS value "
    f"FROM (SELECT person_id, {value} AS tidy FROM labelled), (SELECT DISTINCT {value} AS v FROM labelled WHERE {value} IS NOT NULL)"
    for c, value in (("sex", "CASE WHEN sex = 'No matching concept' THEN 'unknown' ELSE sex END"), ("race", "race"), ("ethn", "ethn"))), *_AN)
ORACLES["training_prevalence_over_few"] = ORACLES["training_prevalence"] + " HAVING count(DISTINCT f.person_id) > 3"
ORACLES["model_file"] = _sql('SELECT person_id, "window", TRUE AS same_score FROM tr', *_RO)
