"""Labels, thresholds and formats of the data contract.

They have to equal the values stored in the data, so they stay in the language
of the data.
"""

# Source, entity and geocoder names.
PERMIT_SOURCE = "alvaras_smf"
CODE_SOURCE = "ibge_cnae"
TERRITORY_SOURCE = "geocuritiba_bairro"
EVENT_DETECTION_JOB = "event_detection_comercio"
BUSINESS = "comercio"
PRIMARY_GEOCODER = "geocodebr"
SECONDARY_GEOCODER = "nominatim"

# Event types.
FIRST_SEEN = "PRIMEIRA_OBSERVACAO"
OPENED = "ABERTURA_CONFIRMADA"
VANISHED = "DESAPARECIMENTO"
CLOSED = "FECHAMENTO_CONFIRMADO"
RECLASSIFIED = "MUDANCA_CATEGORIA"
EVENT_TYPES = (FIRST_SEEN, OPENED, VANISHED, CLOSED, RECLASSIFIED)
OPENING_TYPES = (FIRST_SEEN, OPENED)
COUNTED_TYPES = (FIRST_SEEN, OPENED, VANISHED)
REPORTED_TYPES = (FIRST_SEEN, VANISHED)

# Confidence labels.
HIGH = "alta"
MEDIUM = "media"
LOW = "baixa"
CONFIDENCES = (HIGH, MEDIUM, LOW)
MAIN_CONFIDENCES = (HIGH, MEDIUM)

# Territory levels, run status.
NEIGHBOURHOOD = "bairro"
TERRITORY_LEVELS = ("bairro", "rua", "grid", "cidade")
RUN_OK = "sucesso"
RUN_FAILED = "falha"

# Trend labels and reasons an indicator is missing.
ACCELERATING = "acelerando"
SLOWING = "desacelerando"
STABLE = "estavel"
SHORT_HISTORY = "historico_insuficiente"
ZERO_BASELINE = "baseline_zero"
INCOMPLETE_MONTH = "mes_incompleto"
NEEDS_TERRITORY = "nao_aplicavel_sem_territorio_id"

# Display fallbacks.
NO_TERRITORY = "(sem bairro)"
NO_CATEGORY = "(sem categoria)"
UNKNOWN_NAME = "?"

# Candidate status.
FOUND = "sucesso"
NOT_FOUND = "falha"
AMBIGUOUS = "ambiguo"

# Place constants.
CITY_ID = "curitiba"
CITY = "Curitiba"
STATE = "PR"
ADDRESS_TAIL = "Curitiba, PR, Brasil"

# Windows of the monthly indicators, in months.
BASELINE_MONTHS = 24
MIN_BASELINE_MONTHS = 3
MIN_TREND_MONTHS = 2
TREND_THRESHOLD = 0.10
HISTORY_MONTHS = 40
SPARKLINE_MONTHS = 12

# Distances in metres.
METRES_PER_DEGREE = 111_320.0
SAME_PLACE_M = 50.0
AGREEMENT_M = 150.0
SEVERE_M = 1000.0
MAX_RADIUS_M = 5000
MIN_ADDRESS_LENGTH = 3
EXACT_PRECISION = "numero"

# Default sizes of the reports.
RANKING_LIMIT = 10
BREAKDOWN_LIMIT = 5
REPORT_LIMIT = 10
SEVERE_LIMIT = 20
