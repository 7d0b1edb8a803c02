"""Table layouts and fixed values of the fund-quote data model."""

from pyspark.sql import types as T

# Table layouts.
REGISTER = T.StructType([
    T.StructField("cnpj", T.StringType(), False),
    T.StructField("nome", T.StringType(), False),
    T.StructField("atualizado_em", T.TimestampType(), False),
])
QUOTES = T.StructType([
    T.StructField("cnpj", T.StringType(), False),
    T.StructField("id_subclasse", T.StringType(), False),
    T.StructField("data", T.DateType(), False),
    T.StructField("valor_cota", T.DoubleType(), False),
    T.StructField("arquivo_origem", T.StringType(), False),
    T.StructField("atualizado_em", T.TimestampType(), False),
])
LEDGER = T.StructType([
    T.StructField("arquivo", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("periodo_inicial", T.StringType(), False),
    T.StructField("periodo_final", T.StringType(), False),
    T.StructField("processado_em", T.TimestampType(), True),
    T.StructField("linhas_inseridas", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("erro", T.StringType(), True),
])
QUOTE_KEY = ("cnpj", "id_subclasse", "data")

# Long panel used by every analytic operator: one row per series and date, an absent quote is an absent row.
PANEL = T.StructType([
    T.StructField("serie", T.StringType(), True),
    T.StructField("data", T.DateType(), True),
    T.StructField("valor", T.DoubleType(), True),
])

# Archive names, funds outside the universe, status words.
ARCHIVE_NAME = r"^inf_diario_fi_(\d{4})(\d{2})?\.zip$"
EXCLUDED_IDS = ("17098794000170", "31887401000139", "42066916000194")
STATUS_OK = "OK"
STATUS_ERROR = "ERRO"
STATUS_EMPTY = "SEM DADOS"

# Column names of the daily files (after header normalisation).
ID_COLUMNS = ("CNPJ_FUNDO_CLASSE", "CNPJ_FUNDO")
SUBCLASS_COLUMN = "ID_SUBCLASSE"
DATE_COLUMN = "DT_COMPTC"
VALUE_COLUMN = "VL_QUOTA"

# Statistics and portfolio defaults.
TRADING_DAYS = 252
MIN_RETURNS = 60
MIN_ALLOCATION = 0.01
FRONTIER_POINTS = 60
CANDIDATES = 3000
SEED = 42
WEIGHT_EPSILON = 0.00005
RECENT_MONTHS = 2
ERROR_TEXT_LIMIT = 2000
SOURCE_WINDOW_YEARS = 9

# Benchmark choices, with display name, source note and source code.
NO_BENCHMARK = "Nenhum"
RATES_BENCHMARK = "CDI"
CLOSES_BENCHMARK = "Ibovespa"
BENCHMARKS = {
    RATES_BENCHMARK: ("Benchmark: CDI", "CDI: SGS 12 — Banco Central do Brasil.", "12"),
    CLOSES_BENCHMARK: ("Benchmark: Ibovespa", "Ibovespa (^BVSP): Yahoo Finance, coluna Close.", "^BVSP"),
}
