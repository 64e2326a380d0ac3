"""Fixed values that results depend on.

FIXED VALUES — these must equal the values the original application uses
(labels, bins, weights, zone boxes, thresholds); they are listed plainly,
in their natural order.
"""

# Column-name defaults of the canonical incident schema.
TS = "data_ocorrencia"
TYPE = "tipo_crime"
ZONE = "bairro"
LAT = "latitude"
LON = "longitude"
METHOD = "descricao_modus_operandi"
WEAPON = "arma_utilizada"
SEX = "sexo_suspeito"
AGE = "idade_suspeito"
VICTIMS = "quantidade_vitimas"
SUSPECTS = "quantidade_suspeitos"
STATUS = "status_investigacao"
PRECINCT = "orgao_responsavel"
ID = "occurrence_id"

# FIXED VALUES: weekday names, Monday first (ISO 1..7).
WEEKDAYS_LOWER = ["segunda-feira", "terça-feira", "quarta-feira", "quinta-feira",
                  "sexta-feira", "sábado", "domingo"]
WEEKDAYS_CAPITAL = ["Segunda-feira", "Terça-feira", "Quarta-feira", "Quinta-feira",
                    "Sexta-feira", "Sábado", "Domingo"]
WEEKDAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# FIXED VALUES: periods of the day (hour ranges are half-open [lo, hi)).
PERIODS = [(6, 12, "Manhã"), (12, 18, "Tarde"), (18, 24, "Noite")]
PERIOD_ELSE = "Madrugada"

UNKNOWN = "Não Informado"

# FIXED VALUES: right-closed bins (lo, hi] and labels.
AGE_BINS = [0, 18, 25, 35, 50, 100]
AGE_LABELS = ["<18", "18-25", "26-35", "36-50", ">50"]
AGE_LABELS_VICTIM = ["Menor de 18", "18-25", "26-35", "36-50", "Acima de 50"]
SEVERITY_BINS = [0, 10, 20, 100]
SEVERITY_LABELS = ["Baixa", "Média", "Alta"]
CASE_GRAVITY_BINS = [-1, 0, 2, 10]
CASE_GRAVITY_LABELS = ["Baixa", "Média", "Alta"]

# FIXED VALUES: severity weights by incident type (default 1).
TYPE_WEIGHTS = {
    "Homicídio": 10, "Latrocínio": 9, "Sequestro": 8, "Estupro": 8,
    "Roubo": 6, "Extorsão": 5, "Furto": 3, "Estelionato": 2, "Ameaça": 2,
}
# FIXED VALUES: severity weights by weapon (default 1).
WEAPON_WEIGHTS = {"Arma de Fogo": 5, "Arma Branca": 3, "Outros": 2, "Sem Arma": 1}
DEFAULT_WEIGHT = 1

# FIXED VALUES: case gravity points by weapon.
CASE_WEAPON_POINTS = {"Arma de Fogo": 3, "Faca": 2}
LETHAL_WEAPONS = ["Arma de Fogo", "Faca"]
FIREARM = "Arma de Fogo"

# FIXED VALUES: scope of the case dashboard.
CASE_TYPES = ["Violência Doméstica", "Estupro", "Ameaça"]

# FIXED VALUES: case status labels.
STATUS_DONE = "Concluído"
STATUS_OPEN = "Em Investigação"
STATUS_ARCHIVED = "Arquivado"

# FIXED VALUES: city box (inclusive).
CITY_LAT = (-8.12, -8.05)
CITY_LON = (-34.95, -34.85)

# FIXED VALUES: zone boxes (zone, centre latitude, centre longitude, half-width).
ZONE_BOXES = [
    ("Pina", -8.088, -34.885, 0.015),
    ("Boa Viagem", -8.113, -34.896, 0.020),
    ("Imbiribeira", -8.118, -34.906, 0.015),
    ("Casa Forte", -8.038, -34.925, 0.015),
    ("Graças", -8.058, -34.898, 0.012),
    ("Espinheiro", -8.048, -34.898, 0.012),
    ("Tamarineira", -8.028, -34.908, 0.015),
    ("Torre", -8.048, -34.908, 0.012),
    ("Afogados", -8.068, -34.918, 0.015),
    ("Santo Amaro", -8.078, -34.888, 0.012),
]

# FIXED VALUES: marker colour per incident type (default grey).
TYPE_COLOURS = {
    "Estupro": "red", "Violência Doméstica": "darkred", "Ameaça": "orange",
    "Lesão Corporal": "purple", "Injúria": "blue",
}
DEFAULT_COLOUR = "gray"

# FIXED VALUES: risk tiers and their quantiles.
RISK_LOW, RISK_MID, RISK_HIGH = "Baixo Risco", "Médio Risco", "Alto Risco"
RISK_QUANTILES = (0.33, 0.66)

# FIXED VALUES: insight thresholds.
REPORT_TOP_ZONE_SHARE = 20.0
REPORT_RESOLUTION_LOW = 70.0
REPORT_RESOLUTION_HIGH = 85.0
CLUSTER_ZONE_SHARE = 70.0
ANOMALY_NIGHT_SHARE = 0.5
ANOMALY_ZONE_SHARE = 0.3
FAIRNESS_FACTOR = 1.5
NIGHT_FROM, NIGHT_TO = 22, 6

# FIXED VALUES: hexagon radius in metres and metres per degree at this latitude.
HEX_RADIUS_M = 200.0
M_PER_DEG_LAT = 111320.0
M_PER_DEG_LON = 110201.0
