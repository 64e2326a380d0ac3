"""DuckDB text of the test bindings, shared by every oracle query.

These CTEs restate ``sentinela.sources.binding`` and the rule-labelled
fixtures in plain SQL; each oracle query is ``WITH <ctes> <select>``.
"""

OCC = """occ AS (
  SELECT e.event_id AS occurrence_id,
         e.ts AS data_ocorrencia,
         CASE e.event_type WHEN 'click' THEN 'Violência Doméstica' WHEN 'error' THEN 'Roubo'
              WHEN 'purchase' THEN 'Estelionato' WHEN 'signup' THEN 'Ameaça' WHEN 'view' THEN 'Furto' END AS tipo_crime,
         n.n_name AS bairro,
         CAST(-8.12 AS DOUBLE) + CAST((e.event_id*7919) % 1000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS latitude,
         CAST(-34.95 AS DOUBLE) + CAST((e.event_id*104729) % 1000 AS DOUBLE)/CAST(8000 AS DOUBLE) AS longitude,
         concat('MO-', CAST(e.user_id % 12 AS VARCHAR)) AS descricao_modus_operandi,
         CASE e.k % 5 WHEN 0 THEN 'Arma de Fogo' WHEN 1 THEN 'Faca' WHEN 2 THEN 'Arma Branca'
              WHEN 3 THEN 'Sem Arma' ELSE 'Outros' END AS arma_utilizada,
         CASE e.k % 3 WHEN 0 THEN 'Feminino' WHEN 1 THEN 'Masculino' END AS sexo_suspeito,
         CAST(e.user_id % 101 AS INTEGER) AS idade_suspeito,
         CAST(1 + e.k % 4 AS INTEGER) AS quantidade_vitimas,
         CAST(1 + e.k % 3 AS INTEGER) AS quantidade_suspeitos,
         CASE WHEN e.event_id % 10 < 6 THEN 'Concluído' WHEN e.event_id % 10 < 9 THEN 'Em Investigação'
              ELSE 'Arquivado' END AS status_investigacao,
         r.r_name AS orgao_responsavel
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
  JOIN nation n ON n.n_nationkey = e.user_id % 25
  JOIN region r ON r.r_regionkey = n.n_regionkey
)"""

CAL = """cal AS (
  SELECT *, CAST(hour(data_ocorrencia) AS INTEGER) AS hora, CAST(month(data_ocorrencia) AS INTEGER) AS mes,
         CAST(year(data_ocorrencia) AS INTEGER) AS ano, CAST(day(data_ocorrencia) AS INTEGER) AS dia_mes,
         CAST(isodow(data_ocorrencia) AS INTEGER) AS dow
  FROM occ
)"""

ORD = """ordi AS (
  SELECT o.o_orderkey AS occurrence_id, o.o_orderdate AS data_ocorrencia, o.o_orderpriority AS tipo_crime,
         n.n_name AS bairro, c.c_mktsegment AS descricao_modus_operandi,
         CASE o.o_orderstatus WHEN 'F' THEN 'Concluído' WHEN 'O' THEN 'Em Investigação' ELSE 'Arquivado' END
           AS status_investigacao
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

# rule-labelled table: cluster −1..4 and anomaly flag from the id (FIXTURES.md)
LAB = """lab AS (
  SELECT *, CAST(occurrence_id % 6 AS INTEGER) - 1 AS cluster,
         CASE WHEN occurrence_id % 20 = 0 THEN -1 ELSE 1 END AS anomalia
  FROM cal
)"""

RISK = """zc AS (SELECT bairro, count(*) AS zona_n FROM occ WHERE bairro IS NOT NULL GROUP BY bairro),
qs AS (SELECT round(quantile_cont(CAST(zona_n AS DOUBLE), 0.33), 9) AS q1,
              round(quantile_cont(CAST(zona_n AS DOUBLE), 0.66), 9) AS q2 FROM zc),
risk AS (
  SELECT o.*, CASE WHEN coalesce(zc.zona_n, 0) <= qs.q1 THEN 'Baixo Risco'
                   WHEN coalesce(zc.zona_n, 0) <= qs.q2 THEN 'Médio Risco' ELSE 'Alto Risco' END AS nivel_risco
  FROM lab o LEFT JOIN zc USING (bairro) CROSS JOIN qs
)"""

PRED = """pred AS (
  SELECT occurrence_id, bairro, nivel_risco AS label,
         CASE WHEN occurrence_id % 7 = 0 THEN
              CASE nivel_risco WHEN 'Baixo Risco' THEN 'Médio Risco' WHEN 'Médio Risco' THEN 'Alto Risco'
                   ELSE 'Baixo Risco' END
              ELSE nivel_risco END AS prediction
  FROM risk
)"""

NBOX = """nbox AS (
  SELECT n.n_name AS zone, b.lat_c, b.lon_c, b.radius
  FROM nation n JOIN (VALUES
    (0, CAST(-8.088 AS DOUBLE), CAST(-34.885 AS DOUBLE), CAST(0.015 AS DOUBLE)),
    (1, CAST(-8.113 AS DOUBLE), CAST(-34.896 AS DOUBLE), CAST(0.020 AS DOUBLE)),
    (2, CAST(-8.118 AS DOUBLE), CAST(-34.906 AS DOUBLE), CAST(0.015 AS DOUBLE)),
    (3, CAST(-8.038 AS DOUBLE), CAST(-34.925 AS DOUBLE), CAST(0.015 AS DOUBLE)),
    (4, CAST(-8.058 AS DOUBLE), CAST(-34.898 AS DOUBLE), CAST(0.012 AS DOUBLE)),
    (5, CAST(-8.048 AS DOUBLE), CAST(-34.898 AS DOUBLE), CAST(0.012 AS DOUBLE)),
    (6, CAST(-8.028 AS DOUBLE), CAST(-34.908 AS DOUBLE), CAST(0.015 AS DOUBLE)),
    (7, CAST(-8.048 AS DOUBLE), CAST(-34.908 AS DOUBLE), CAST(0.012 AS DOUBLE)),
    (8, CAST(-8.068 AS DOUBLE), CAST(-34.918 AS DOUBLE), CAST(0.015 AS DOUBLE)),
    (9, CAST(-8.078 AS DOUBLE), CAST(-34.888 AS DOUBLE), CAST(0.012 AS DOUBLE))
  ) AS b(slot, lat_c, lon_c, radius) ON n.n_nationkey % 10 = b.slot
  WHERE n.n_nationkey < 20
)"""

SEV = """sev AS (
  SELECT *, CAST(
      coalesce(CASE tipo_crime WHEN 'Homicídio' THEN 10 WHEN 'Latrocínio' THEN 9 WHEN 'Sequestro' THEN 8
                 WHEN 'Estupro' THEN 8 WHEN 'Roubo' THEN 6 WHEN 'Extorsão' THEN 5 WHEN 'Furto' THEN 3
                 WHEN 'Estelionato' THEN 2 WHEN 'Ameaça' THEN 2 END, 1)
    + coalesce(CASE arma_utilizada WHEN 'Arma de Fogo' THEN 5 WHEN 'Arma Branca' THEN 3 WHEN 'Outros' THEN 2
                 WHEN 'Sem Arma' THEN 1 END, 1)
    + quantidade_vitimas * 2 + quantidade_suspeitos AS INTEGER) AS indice_gravidade
  FROM occ
),
sevl AS (
  SELECT *, CASE WHEN indice_gravidade > 0 AND indice_gravidade <= 10 THEN 'Baixa'
                 WHEN indice_gravidade > 10 AND indice_gravidade <= 20 THEN 'Média'
                 WHEN indice_gravidade > 20 AND indice_gravidade <= 100 THEN 'Alta' END AS nivel_gravidade
  FROM sev
)"""

AGEBAND = """CASE WHEN idade_suspeito > 0 AND idade_suspeito <= 18 THEN '<18'
     WHEN idade_suspeito > 18 AND idade_suspeito <= 25 THEN '18-25'
     WHEN idade_suspeito > 25 AND idade_suspeito <= 35 THEN '26-35'
     WHEN idade_suspeito > 35 AND idade_suspeito <= 50 THEN '36-50'
     WHEN idade_suspeito > 50 AND idade_suspeito <= 100 THEN '>50' END"""

_ORDER = ["occ", "cal", "ordi", "lab", "risk", "pred", "nbox", "sev"]
_TEXT = {"occ": OCC, "cal": CAL, "ordi": ORD, "lab": LAB, "risk": RISK, "pred": PRED, "nbox": NBOX, "sev": SEV}
_NEEDS = {"cal": ["occ"], "lab": ["cal"], "risk": ["lab"], "pred": ["risk"], "sev": ["occ"]}


def with_(*names: str, extra: str | None = None) -> str:
    """``WITH`` clause holding the named CTEs and what they depend on, plus
    ``extra`` CTE text of the query itself."""
    want: set[str] = set()

    def add(n):
        if n in want:
            return
        want.add(n)
        for d in _NEEDS.get(n, []):
            add(d)
    for n in names:
        add(n)
    parts = [_TEXT[n] for n in _ORDER if n in want] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n"


def rhu(expr: str, digits: int) -> str:
    """SQL twin of ``round_half_up``."""
    p = f"{10.0 ** digits!r}"
    return f"(floor(({expr}) * {p} + 0.5) / {p})"


def pct(num: str, den: str, digits: int | None = None) -> str:
    """SQL twin of ``scalar.pct``."""
    v = f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END * 100.0)"
    return rhu(v, digits) if digits is not None else v
