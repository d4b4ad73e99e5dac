"""The same stand-in views as SQL common table expressions, for the cross-check."""

STAGE = "CASE {c} WHEN 0 THEN 'Wake' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' WHEN 4 THEN 'REM' END"
CLASSES = "cls AS (SELECT * FROM (VALUES ('Wake',0),('N1',1),('N2',2),('N3',3),('REM',4)) t(sleep_stage, code))"

EP = """ep0 AS (SELECT user_id AS subject_id, 'R' || CAST(user_id AS VARCHAR) AS recording_id, 1 AS night,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch_id,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END AS sleep_stage_encoded,
  value AS v, value > 200 AS quality_issue_flag, event_id, ts FROM events),
ep AS (SELECT *, """ + STAGE.format(c="sleep_stage_encoded") + """ AS sleep_stage, epoch_id * 30.0::DOUBLE AS start_time_sec FROM ep0)"""

FT = """ft0 AS (SELECT l_suppkey % 20 AS subject_id, 'R' || CAST(l_suppkey % 20 AS VARCHAR) AS recording_id,
  (l_linenumber - 1) % 5 AS sleep_stage_encoded, l_quantity AS delta_power, l_extendedprice / 1000 AS theta_power,
  l_discount * 100 AS alpha_power, l_tax * 100 AS beta_power, l_extendedprice AS signal_energy FROM lineitem),
ft AS (SELECT *, """ + STAGE.format(c="sleep_stage_encoded") + """ AS sleep_stage FROM ft0)"""

REL = """rel AS (SELECT *, delta_power / tot AS relative_delta_power, theta_power / tot AS relative_theta_power,
  alpha_power / tot AS relative_alpha_power, beta_power / tot AS relative_beta_power
  FROM (SELECT *, delta_power + theta_power + alpha_power + beta_power AS tot FROM ft))"""

FT_LONG = """fl AS (SELECT subject_id, recording_id, sleep_stage, 'delta_power' AS feature, delta_power AS value FROM ft
  UNION ALL SELECT subject_id, recording_id, sleep_stage, 'theta_power', theta_power FROM ft
  UNION ALL SELECT subject_id, recording_id, sleep_stage, 'alpha_power', alpha_power FROM ft
  UNION ALL SELECT subject_id, recording_id, sleep_stage, 'beta_power', beta_power FROM ft
  UNION ALL SELECT subject_id, recording_id, sleep_stage, 'signal_energy', signal_energy FROM ft)"""

SG = """sg AS (SELECT vec_id AS epoch_id, 'S' || CAST(vec_id // 50 AS VARCHAR) AS recording_id, vec_id % 50 AS chunk,
  list_transform(embedding, lambda e: CAST(e AS DOUBLE) * (100.0::DOUBLE * (1 + vec_id % 7))) AS x FROM embeddings)"""

SG_LONG = """sl AS (SELECT epoch_id, recording_id, chunk, unnest(x) AS v, unnest(range(len(x))) AS i FROM sg)"""

AN = """an0 AS (SELECT 'R' || CAST(user_id AS VARCHAR) AS recording_id, user_id AS subject_id, event_id,
  floor((floor(epoch(ts)) - 1704067200) / 3600) * 3600.0::DOUBLE AS onset,
  CASE event_type WHEN 'error' THEN 'Sleep stage W' WHEN 'view' THEN 'Sleep stage 1' WHEN 'click' THEN 'Sleep stage 2'
    WHEN 'purchase' THEN 'Sleep stage 4' WHEN 'signup' THEN 'Movement time' END AS label FROM events),
an AS (SELECT * FROM (SELECT *, lead(onset) OVER (PARTITION BY recording_id ORDER BY onset, event_id) - onset AS duration FROM an0)
  WHERE duration > 0)"""

PR = EP + """,
pr0 AS (SELECT *, list_transform([0,1,2,3,4], lambda i: CAST(1 + ((event_id * (7 + 2*i) + 13*i*i) % 97) AS DOUBLE)) AS raw FROM ep),
pr1 AS (SELECT *, list_transform(raw, lambda r: r / list_sum(raw)) AS p FROM pr0),
pr2 AS (SELECT *, list_position(p, list_max(p)) - 1 AS top FROM pr1),
pr AS (SELECT subject_id, recording_id, night, epoch_id, event_id, CAST(subject_id % 4 AS INTEGER) AS cohort,
  CAST(subject_id % 4 + 1 AS INTEGER) AS outer_fold, sleep_stage_encoded AS y_true,
  CAST(CASE WHEN event_id % 50 = 0 THEN (top + 1) % 5 ELSE top END AS INTEGER) AS y_pred, p, CAST(top AS INTEGER) AS y_arg FROM pr2)"""


def with_views(*views: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views) + "\n" + select
