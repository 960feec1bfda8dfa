"""Word lists that decide results."""

# Marketing phrases that carry no product information.
MARKETING_NOISE = (
    "affare",
    "affarone",
    "best price",
    "imperdibile",
    "offerta",
    "ottima offerta",
    "prezzo bomba",
    "promo",
    "super offerta",
    "vendo",
)

# Words that tell the condition, and the condition each one means.
CONDITION_TERMS = {
    "nuovo": "new",
    "nuova": "new",
    "new": "new",
    "sigillato": "new_sealed",
    "sealed": "new_sealed",
    "ricondizionato": "refurbished",
    "ricondiziato": "refurbished",
    "refurbished": "refurbished",
    "usato": "used",
    "used": "used",
    "difettoso": "for_parts",
    "non funzionante": "for_parts",
    "for parts": "for_parts",
}

# The order in which conditions win.
CONDITION_ORDER = ("for_parts", "refurbished", "new_sealed", "new", "used")

# Character pairs that show UTF-8 read as Latin-1.
MOJIBAKE_MARKS = ("â", "Ã", "Â", "ð", "ç¬", "è®", "æ")

# Words without evidence value when a listing is checked on the web.
EVIDENCE_STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "all", "view", "categories",
    "new", "used", "refurbished", "ricondizionato", "apple", "weeks",
    "just", "few", "left", "bestseller", "deal", "deals", "sale",
    "phone", "phones", "smartphone", "smartphones", "cellulari", "telefoni",
    "laptop", "laptops", "tablet", "tablets", "accessories", "accessori",
    "di", "da", "per", "con", "il", "la", "lo", "gli", "le", "un", "una",
)

# Catalog brands and the words that show them, in test order.
CATALOG_BRANDS = {
    "nvidia": ("nvidia", "geforce", "quadro"),
    "amd": ("amd", "radeon", "firepro"),
    "intel": ("intel", "arc", "core", "xeon"),
    "asus": ("asus", "rog", "tuf"),
    "msi": ("msi",),
    "gigabyte": ("gigabyte", "aorus"),
    "pny": ("pny",),
    "zotac": ("zotac",),
    "sapphire": ("sapphire",),
    "kingston": ("kingston", "hyperx"),
    "corsair": ("corsair", "vengeance"),
    "crucial": ("crucial", "micron"),
    "samsung": ("samsung",),
    "lg": ("lg",),
    "dell": ("dell", "alienware"),
    "lenovo": ("lenovo", "thinkpad", "legion"),
    "hp": ("hp", "hewlett", "omen", "zbook", "elitebook"),
    "google": ("google", "pixel"),
    "apple": ("apple", "iphone", "ipad", "macbook", "apple watch"),
}

# Product-line words that win over component words, in test order.
BRAND_LINES = (
    (r"\b(hp|zbook|elitebook|omen)\b", "hp"),
    (r"\b(thinkpad|lenovo|legion)\b", "lenovo"),
    (r"\b(macbook|ipad|iphone|apple\s+watch|apple)\b", "apple"),
    (r"\b(pixel|google)\b", "google"),
    (r"\b(galaxy|samsung)\b", "samsung"),
)

# Brands looked for in listing titles, in test order.
LISTING_BRANDS = (
    "apple", "samsung", "sony", "dell", "lenovo", "hp", "hpe", "asus", "acer",
    "msi", "nvidia", "amd", "intel", "logitech", "bose", "teufel", "yamaha",
    "canon", "nikon", "fujifilm", "ricoh", "transcend", "kingston", "crucial",
    "seagate", "western digital", "wd", "microsoft", "surface", "lg", "philips",
    "ikea", "harley benton", "boss", "ce johansson", "ralph lauren", "lego", "opel", "abu garcia",
)

# Brands written in capitals.
CAPITAL_BRANDS = ("hp", "hpe", "lg", "wd")

# Apple product lines.
APPLE_LINES = r"\b(iphone|ipad|macbook|imac|apple watch|airpods|magic mouse)\b"

# Words that never start a model name.
BAD_MODEL_STARTS = (
    "voor", "vanaf", "van", "dan", "met", "zonder", "nieuw", "oude",
    "old", "new", "from", "with", "without", "for", "website",
    "sinds", "seit", "noin", "circa", "ca", "med",
    "per", "prijs", "price", "geschikt", "ongeveer",
)

# Patterns a model name has to match one of.
GOOD_MODEL_PATTERNS = (
    r"\brtx\s?\d{3,4}(?:\s?ti|\s?super)?\b",
    r"\brx\s?\d{3,4}(?:\s?xt)?\b",
    r"\biphone\s?(?:se\s?)?\d{1,2}\b",
    r"\bmacbook\s?(?:air|pro)?(?:\s?\d{4})?(?:\s?m\d)?\b",
    r"\bthinkpad\s?[a-z]?\d{3,4}[a-z]?\b",
    r"\b[a-z]{1,6}[-\s]?\d{2,5}[a-z0-9\-]*\b",
    r"\b\d{2,5}[a-z]{1,4}\b",
    r"\b[a-z]+\s(?:air|pro|se|max|mini)\s?\d{0,4}\b",
    r"\b[a-z]+\s\d{3,4}gb\b",
)

# Patterns that propose a model name, in test order.
MODEL_HINT_PATTERNS = (
    r"\bRTX\s?\d{3,4}(?:\s?Ti| SUPER)?\b",
    r"\bRX\s?\d{3,4}(?:\s?XT)?\b",
    r"\biPhone\s?(?:SE\s?)?\d{1,2}(?:\s?(?:Pro|Max|Plus|mini|Air))*\b",
    r"\bMacBook\s?(?:Air|Pro)?\s?\d{4}?\s?(?:M\d)?\b",
    r"\bThinkPad\s?[A-Z]?\d{3,4}[A-Z]?\b",
    r"\bDL\d{3,4}\b",
    r"\bU\d{4}[A-Za-z]*\b",
    r"\bP\d{4}[A-Za-z]*\b",
    r"\b[A-Z]{2,6}[-\s]?\d{2,5}[A-Z0-9\-]*\b",
)
