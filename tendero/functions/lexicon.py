"""Word lists, unit tables and defaults the results depend on."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------

# Units of content: spelling -> (canonical unit, factor to the canonical unit).
CONTENT_UNITS = {
    "ml": ("ml", 1),
    "mililitro": ("ml", 1),
    "mililitros": ("ml", 1),
    "cc": ("ml", 1),
    "l": ("ml", 1000),
    "lt": ("ml", 1000),
    "lts": ("ml", 1000),
    "litro": ("ml", 1000),
    "litros": ("ml", 1000),
    "g": ("g", 1),
    "gr": ("g", 1),
    "grs": ("g", 1),
    "gramo": ("g", 1),
    "gramos": ("g", 1),
    "kg": ("g", 1000),
    "kilo": ("g", 1000),
    "kilos": ("g", 1000),
    "kilogramo": ("g", 1000),
}

# Units that count pieces; they say nothing about the content.
COUNT_UNITS = ["und", "unidad", "unidades", "un", "unds"]

PACK_MIN, PACK_MAX = 2, 48
BARCODE_MIN_DIGITS, BARCODE_MAX_DIGITS = 8, 14

NO_NAME_SLUG = "sin-nombre"
NO_BRAND = "sin-marca"
NO_QUANTITY = "sin-cantidad"
OTHER_CATEGORY = "Otros"

LIQUOR_WORDS = [
    "aguardiente", "aperitivo", "brandy", "cerveza", "champagne", "cognac",
    "coñac", "espumante", "gin", "licor", "ron", "tequila", "vodka", "vino",
    "whisky", "whiskey", "vermut",
]
LIQUOR_NOISE = [
    "cuchara", "coctelera", "jigger", "medidor", "mortero", "pasta", "vaso",
]

CATEGORY_WORDS = {
    "licores": [
        "whisky", "cerveza", "ron", "tequila", "vodka", "ginebra", "aguardiente", "licor",
    ],
    "vinos": [
        "vino", "espumante", "champagne", "champaña", "merlot", "cabernet", "malbec",
        "sauvignon",
    ],
    "bebidas": [
        "gaseosa", "soda", "cola", "agua", "hidratante", "isotonica", "jugo", "refresco",
        "malta", "energizante",
    ],
    "snacks": [
        "snack", "papas", "pasabocas", "galleta", "chocolate", "mani", "nueces", "chicle",
        "tajin", "nachos", "doritos",
    ],
    "dulceria": [
        "dulceria", "dulce", "chupeta", "caramelo", "gomita", "gomitas", "chocolate",
        "toffee", "confite", "menta",
    ],
}
CATEGORY_NOISE = [
    "bateria", "ollas", "freidora", "triturador", "cocina", "aseo", "limpieza", "maquina",
    "electro", "mueble", "ropa", "zapato", "juguete", "salud", "belleza", "mascarilla",
    "shampoo", "crema",
]

# Category words that select the drinks part of a raw dump.
DUMP_CATEGORY_WORDS = [
    "licores", "vinhos", "cervezas", "alcohol", "ron", "aguardiente", "whisky", "vodka",
    "tequila", "ginebra",
]

# Image hosts: product photos live under the first, seals and banners under the second.
ASSET_MARKERS = ["vtexassets.com", "/arquivos/ids/"]
BLOCKED_IMAGE_MARKERS = ["sellos", "cucarda", "imprecionantes", "cloudfront.net"]

# Discount rules.
DROP_RATIO = 0.98          # below this share of the highest price it is a discount
LIST_PRICE_RATIO = 1.02    # list price must exceed the current one by this factor
SAME_PRICE_TOLERANCE = 0.01
EVENT_WINDOW_DAYS = 7
NOTE_OBSERVED = "precio base observado"
NOTE_LIST_PRICE = "precio de lista observado en el sitio"
NOTE_HOLIDAY = "festivo"
NOTE_NEAR_HOLIDAY = "puente festivo cercano"
NOTE_LOCAL_MATCH = "partido local cercano"
NOTE_MATCH_AT = "partido cercano (%s)"
DEFAULT_MATCH_LABEL = "Real Cartagena local"

# Holidays on a fixed day: (position, month, day, moved to Monday, name).
FIXED_HOLIDAYS = [
    (1, 1, 1, False, "Año Nuevo"),
    (2, 1, 6, True, "Reyes Magos"),
    (3, 3, 19, True, "San José"),
    (6, 5, 1, False, "Día del Trabajo"),
    (7, 6, 29, True, "San Pedro y San Pablo"),
    (8, 7, 20, True, "Independencia de Colombia"),
    (9, 8, 7, False, "Batalla de Boyacá"),
    (10, 8, 15, True, "Asunción de la Virgen"),
    (11, 10, 12, True, "Día de la Raza"),
    (12, 11, 1, True, "Todos los Santos"),
    (13, 11, 11, True, "Independencia de Cartagena"),
    (14, 12, 8, False, "Inmaculada Concepción"),
    (15, 12, 25, False, "Navidad"),
]
# Holidays counted from Easter Sunday: (position, days, moved to Monday, name).
EASTER_HOLIDAYS = [
    (4, -3, False, "Jueves Santo"),
    (5, -2, False, "Viernes Santo"),
    (16, 39, True, "Ascensión del Señor"),
    (17, 60, True, "Corpus Christi"),
    (18, 68, True, "Sagrado Corazón"),
]

# Patterns of titles and prices. ``{units}`` stands for the unit words.
QUANTITY_PATTERN = r"(?<![\p{{L}}\p{{N}}_.])([0-9]+(?:[.,][0-9]+)?)\s*({units})(?![a-z])"
PACK_PATTERN = r"(?U)\bx\s*([0-9]{1,2})\b|\b([0-9]{1,2})\s*pack\b"
NUMBER_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
MONEY_PATTERN = r"\$\s*[0-9.]+(?:,[0-9]{2})?"
PRICE_TEXT_PATTERN = r"\$\s*(?:[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,})"

# Search and paging.
SIMILARITY_THRESHOLD = 0.3
CANDIDATES_PER_LISTING = 5
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 50, 200
BRAND_LIMIT_DEFAULT, BRAND_LIMIT_MAX = 200, 1000
RUN_LIMIT_DEFAULT = 50
CART_MAX_ITEMS, CART_MAX_QUANTITY = 100, 999
COMPARE_MAX_LISTINGS = 4

# Identity.
BARCODE_CONFIDENCE, ATTRIBUTE_CONFIDENCE = 1.0, 0.8
MATCH_METHODS = ["barcode", "shared_product_id", "attributes", "similarity", "manual"]
RUN_STATUSES = ["running", "completed", "failed"]

# Price ranges used to split an oversized source. A range is cut at
# the root of max(its low end, SPLIT_FLOOR) times its high end.
PRICE_FLOOR, PRICE_CEILING = 1, 100_000_000
SPLIT_FLOOR = 100
RANGE_CAP, RANGE_DEPTH = 2500, 6

# History windows.
HISTORY_DAYS, HISTORY_SNAPSHOTS, ANALYSIS_SNAPSHOTS, KEEP_SNAPSHOTS = 30, 8, 3, 3
REFRESH_MINUTES, CACHE_TTL_MINUTES = 180, 30
