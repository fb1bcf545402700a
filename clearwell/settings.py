"""Thresholds, labels and lookup lists that decide a result.

Everything in this module is a fixed value: results are only comparable with
earlier reports when these stay as they are.
"""

# --- fixed values: thresholds -------------------------------------------------
NULL_CRITICAL_PERCENT = 80.0
NULL_SEVERE_PERCENT = 40.0
UTILISATION_CRITICAL_PERCENT = 50.0
UTILISATION_LOW_PERCENT = 80.0
HIGH_CARDINALITY = 0.8
UNIQUE_CARDINALITY = 0.95
CONTENT_SHARE = 0.70
DATE_CONSISTENCY = 0.95
LONG_TEXT = 500
SPECIAL_CHARS_PERCENT = 0.5

# --- fixed values: severity labels --------------------------------------------
CRITICAL, SEVERE, NOTICE, OK = "CRÍTICO", "GRAVE", "AVISO", "OK"
LOW, ACCEPTABLE = "BAJO", "ACEPTABLE"
WHOLE_ROWS = "FILAS_COMPLETAS"
NO_FINDINGS = "Sin incidencias detectadas"

# --- fixed values: value types of single values -------------------------------
TYPE_NULL = "Nulo"
TYPE_INTEGER = "Entero"
TYPE_FLOAT = "Flotante"
TYPE_EMAIL = "Email"
TYPE_PHONE = "Teléfono"
TYPE_URL = "URL"
TYPE_DATE = "Fecha"
TYPE_TEXT = "Texto"

# --- fixed values: keywords looked for inside column names ---------------------
HINT_KEYWORDS = {
    "Fecha/Hora": ["fecha", "date", "time", "hora", "timestamp", "created", "updated", "born"],
    "Email": ["email", "correo", "mail"],
    "Teléfono": ["telefono", "phone", "celular", "mobile", "whatsapp"],
    "URL": ["url", "website", "web", "link"],
}
HINT_IDENTIFIER = "Identificador"
IDENTIFIER_KEYWORDS = ["codigo", "code", "identificador"]

VALIDATOR_KEYWORDS = {
    "email": ["email", "correo", "mail"],
    "phone": ["telefono", "phone", "celular", "mobile"],
    "url": ["url", "website", "web", "link"],
    "date": ["fecha", "date", "time", "hora", "timestamp"],
}
NON_NEGATIVE_KEYWORD = "edad"

SEMANTIC_DATE_KEYWORDS = ["fecha", "date", "timestamp", "created", "updated"]
SEMANTIC_ID_NAMES = [
    "id", "sku", "folio", "codigo", "código", "code", "pedido",
    "cliente", "producto", "customer", "product", "order",
]
SEMANTIC_ID_KEYWORDS = ["sku", "folio", "codigo", "código", "code", "pedido"]
BUSINESS_KEY_NAMES = ["order_id", "product_id", "customer_id", "codigo", "code", "sku"]
DATE_RANGE_PAIRS = [
    ("fecha_inicio", "fecha_fin"),
    ("inicio", "fin"),
    ("start_date", "end_date"),
    ("start", "end"),
]

# --- fixed values: reject categories of the quarantine --------------------------
BAD_NUMBER = "BAD_NUMBER"
BAD_DATE = "BAD_DATE"
BAD_BOOLEAN = "BAD_BOOLEAN"
BAD_EMAIL = "BAD_EMAIL"
BAD_DATE_RANGE = "BAD_DATE_RANGE"

# --- fixed values: delimited text ----------------------------------------------
DELIMITERS = [",", ";", "\t", "|", ":"]
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: words read as booleans ---------------------------------------
TRUE_WORDS = ["true", "1", "yes", "si", "verdadero", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "falso", "n", "f"]

# --- fixed values: date format labels, in the order they are tried ---------------
DATE_FORMATS = [
    "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y",
    "%Y%m%d", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
]
OTHER_DATE_FORMAT = "<formato_no_estándar>"

# --- fixed values: month names, Spanish and English ------------------------------
MONTH_NAMES = {
    1: ["enero", "ene", "january", "jan"],
    2: ["febrero", "feb", "february"],
    3: ["marzo", "mar", "march"],
    4: ["abril", "abr", "april", "apr"],
    5: ["mayo", "may"],
    6: ["junio", "jun", "june"],
    7: ["julio", "jul", "july"],
    8: ["agosto", "ago", "august", "aug"],
    9: ["septiembre", "setiembre", "sep", "september", "sept"],
    10: ["octubre", "oct", "october"],
    11: ["noviembre", "nov", "november"],
    12: ["diciembre", "dic", "december", "dec"],
}
ENGLISH_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]

# --- fixed values: accents that are dropped before words are compared ------------
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# --- fixed values: what counts as white space at the edge of a value -------------
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
