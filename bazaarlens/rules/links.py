"""Link patterns of marketplace sites."""

# Links that are never categories.
SKIP_LINK = (
    r"(login|signin|signup|registr|account|profil|messag|chat|help|aiuto|privacy|cookie|terms|condizioni|"
    r"cart|carrello|checkout|sell|vendi|publish|inserisci|post-ad|advertis|business|about|contatti|"
    r"download|app-store|google-play|facebook|instagram|tiktok|youtube|linkedin|twitter|x\.com|upload|napov|nápov|dotazy|hodnocen|faq|ayuda)"
)
LANGUAGE_SWITCH = r"^(it|en|de|fr|es|pt|nl|be|ch|at|pl|cz|se|dk|fi|no|en nl|nl en|de de|fr fr|it it|es es)$"
GENERIC_NAV = r"^(all categories|view all|show all|tutte le categorie|tutto|tutti|categories|categorie|menu|home|homepage)$"
GENERIC_DEAL = r"^(deals?|offerte|promozioni|apple weeks|black friday|sale|sconti)$"
HARD_NOISE = (
    r"(help|aiuto|hilfe|napov|nápov|dotazy|hodnocen|faq|privacy|cookie|terms|condizioni|upload|"
    r"login|registr|account|profil|messag|chat|contatti|kontakt|about|advertis|reklama|business|"
    r"download|app-store|google-play|rss\b|podm[ií]nky|ochrana|udaj|údaj|nejvyhled|mapa-search|"
    r"mapa-kategorie|mapa\s+kategori|terms|conditions|gdpr|datenschutz)"
)
PRICE_NEARBY = r"\b\d{1,6}\s*(€|eur|chf|gbp|usd)\b"

# Url shapes and words of categories and products.
CATEGORY_URL = (
    r"(/c/|/category|/categorie|/categoria|/catalog|/catalogo|/k/|/s-|/l/|/markt|/marktplaats|"
    r"/recommerce/|/annunci-|/kaufen|/acheter|/search/|/collections?/|/products?/)"
)
SITE_PRODUCT_URL = (
    r"(/p/|/product/[^/?#]+|/products/[^/?#]+|/item/|/itm/|/ad/|/ads/|/annunci/[^/?#]+|/anzeige/[^/?#]+|"
    r"/oferta/[^/?#]+|/listing/[^/?#]+|/product-detail)"
)
CATEGORY_WORDS = (
    r"\b(elettronica|casa|arredo|abbigliamento|scarpe|auto|moto|sport|giardino|bricolage|"
    r"informatica|telefonia|console|libri|musica|bambini|elettrodomestici|bagno|cucina|"
    r"electronics|home|fashion|motors|sports|garden|computers|phones|appliances|furniture|"
    r"kategorien|categorie|categorias|categories|rubriques)\b"
)

# Pagination.
PAGE_PARAMS = ("page", "p", "pagina", "pag")
PAGINATION_URL = r"(?:[?&](?:page|p|pagina|pag)=\d+|/page/\d+|/pagina/\d+|/seite/\d+)"
PAGE_LABEL = r"^(next|avanti|successiva|suivant|weiter|volgende|siguiente|>|»|\d{1,4})$"

# Points of a category by what its label and url say.
TECH = (
    r"(elettronica|electronics|elektronik|elektroniikka|electr[oó]nica|informatica|computer|computers|"
    r"pc\b|laptop|notebook|portatil|portatili|macbook|thinkpad|tablet|ipad|iphone|smartphone|telefono|"
    r"telefoni|telefoner|cellular|samsung|apple|console|playstation|xbox|nintendo|steam\s*deck|gpu|"
    r"scheda\s*video|rtx|radeon|quadro|audio|cuffie|headphones|auricolari|airpods|kamera|camera|"
    r"fotografia|foto|versterkers|receivers|ontvangers|televisies|vitvaror|witgoed|hvidevarer|kodinkoneet)"
)
TECH_STRONG = (
    r"(elettronica|electronics|elektronik|elektroniikka|informatica|computer|laptop|notebook|"
    r"tablet|ipad|iphone|smartphone|telefon|telefoni|telefoner|cellular|console|playstation|xbox|"
    r"gpu|rtx|radeon|audio|cuffie|airpods|versterkers|receivers|ontvangers)"
)
TECH_URL = (
    r"(/c/(smartphone|computer|tablet|cuffie|iphone|ipad|macbook)|/electronics|/elektronik|"
    r"category=.*(electronics|elektronik))"
)
TECH_BRAND = r"\b(apple|samsung|sony|dell|lenovo|hp|nvidia|amd)\b"
INTEREST_POINTS = ((TECH, 30), (TECH_STRONG, 25), (TECH_URL, 20), (TECH_BRAND, 8), (HARD_NOISE, -120))
NEGATIVE = (
    r"(auto'?s|auto\b|moto\b|motor|boot\b|boat|immobili|immobilier|immo\b|real\s*estate|huis|casa\b|"
    r"home|koti|mobili|möbler|møbler|furniture|inredning|indretning|sisustus|abbigliamento|fashion|"
    r"moda|klær|kleidung|vaatteet|vestiti|scarpe|sport|giardino|garden|bricolage|bambini|jobs?|lavoro|"
    r"zwierzęta|zwierzeta|zdrowie|uroda|firma|przemysł|przemysl|budowa|remont|"
    r"help|aiuto|hilfe|napov|nápov|dotazy|hodnocen|faq|privacy|cookie|upload|compra\s+y\s+vende|"
    r"alle\s+anzeigen|s-kategorien|marktplatz\s+\d|antyki|kolekcje|antiques?)"
)
NEGATIVE_POINTS = {"tech": -35, "general": -10, "all": 0}
SOURCE_POINTS = (
    (("marktplaats", "2dehands", "kleinanzeigen", "willhaben"), r"\b(auto|immo|immobili|motor|boot)\b", -30),
    (("blocket", "dba", "tori", "finn"), r"\b(möbler|møbler|koti|sisustus|klær|vaatteet|fashion|mote)\b", -25),
    (("wallapop",), r"\b(moto|honda|cbr|upload|compra\s+y\s+vende)\b", -40),
    (("bazos",), r"\b(nápověda|napoveda|dotazy|hodnocení|hodnoceni|rss|reklama|podm[ií]nky|kontakt)\b", -80),
)
