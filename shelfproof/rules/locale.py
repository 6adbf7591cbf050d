"""Fixed values of the supported locales.

Every table here is a lookup the results depend on: labels, patterns, units
and constants are stated as they must match, in their natural order.  Adding a
locale is a change to this file only.
"""

from __future__ import annotations

# Zero-width and bidi marks dropped from text.
INVISIBLE = "​‌‍‎‏⁠﻿"

# Unit name -> (symbol, factor to grams or millilitres).
UNITS = {
    "g": ("g", 1.0), "gramm": ("g", 1.0), "gramme": ("g", 1.0), "gram": ("g", 1.0),
    "grams": ("g", 1.0), "gr": ("g", 1.0),
    "kg": ("kg", 1000.0), "kilogramm": ("kg", 1000.0), "kilogram": ("kg", 1000.0),
    "kilograms": ("kg", 1000.0),
    "mg": ("mg", 0.001), "milligramm": ("mg", 0.001),
    "ml": ("ml", 1.0), "milliliter": ("ml", 1.0), "millilitre": ("ml", 1.0),
    "l": ("l", 1000.0), "liter": ("l", 1000.0), "litre": ("l", 1000.0),
    "liters": ("l", 1000.0), "litres": ("l", 1000.0),
    "oz": ("oz", 28.3495), "ounce": ("oz", 28.3495), "ounces": ("oz", 28.3495),
    "lb": ("lb", 453.592), "pound": ("lb", 453.592), "pounds": ("lb", 453.592),
}
VOLUME_UNITS = ("ml", "l")

# Host -> (label language, currency, decimal mark, home country).
MARKETPLACES = {
    "amazon.de": ("de", "EUR", ",", "deutschland"),
    "amazon.com": ("en", "USD", ".", "the united states"),
    "amazon.co.uk": ("en", "GBP", ".", "the united kingdom"),
    "amazon.it": ("de", "EUR", ",", "italien"),
}
# Used for any other host: English labels, decimal point, no currency.
FALLBACK = ("en", "", ".", "the united states")

# Currency signs, first match wins.
CURRENCY_SIGNS = (("€", "EUR"), ("£", "GBP"), ("$", "USD"))

# Canonical attribute key -> label aliases per language.
ATTRIBUTE_ALIASES = {
    "brand": {"de": ["marke"], "en": ["brand", "brand name"]},
    "manufacturer": {"de": ["hersteller"], "en": ["manufacturer"]},
    "country_of_origin": {
        "de": ["herkunftsland", "ursprungsland", "herkunftsland des produkts"],
        "en": ["country of origin"]},
    "item_weight": {
        "de": ["artikelgewicht", "nettogewicht", "gewicht"],
        "en": ["item weight", "net weight", "weight"]},
    "package_weight": {"de": ["paketgewicht", "verpackungsgewicht"], "en": ["package weight"]},
    "item_count": {
        "de": ["anzahl der artikel", "anzahl artikel", "stückzahl", "artikelmenge pro paket",
               "anzahl der packungen"],
        "en": ["number of items", "item count", "units per package"]},
    "unit_count": {"de": ["anzahl der einheiten", "anzahl von einheiten"], "en": ["unit count"]},
    "package_size": {
        "de": ["paketgröße - name", "paketgröße", "größe", "grösse"],
        "en": ["size name", "size"]},
    "dimensions": {
        "de": ["produktabmessungen", "verpackungsabmessungen", "abmessungen"],
        "en": ["product dimensions", "package dimensions"]},
    "volume": {
        "de": ["artikelvolumen", "nettovolumen des inhalts", "volumen"],
        "en": ["item volume", "net content volume"]},
    "ingredients": {"de": ["zutaten", "bestandteile", "inhaltsstoffe"], "en": ["ingredients"]},
    "allergen_info": {
        "de": ["allergenhinweis", "allergene"], "en": ["allergen information", "allergens"]},
    "flavour": {"de": ["geschmacksrichtung", "geschmack"], "en": ["flavour", "flavor"]},
    "form": {"de": ["form"], "en": ["form"]},
    "variety": {"de": ["auswahl", "sorte", "spezialität"], "en": ["variety", "speciality"]},
    "material_feature": {
        "de": ["besondere produkteigenschaften", "produkt-features", "eigenschaften"],
        "en": ["specialty", "product features", "special feature"]},
    "storage": {"de": ["lagerungshinweise", "aufbewahrung"], "en": ["storage instructions"]},
    "diet_type": {"de": ["ernährungshinweis", "diät-typ"], "en": ["diet type"]},
    "model_number": {
        "de": ["modellnummer", "hersteller-modellnummer", "herstellerreferenz"],
        "en": ["item model number", "manufacturer reference", "model number"]},
    "gtin": {
        "de": ["global trade identification number"],
        "en": ["global trade identification number", "upc", "ean"]},
    "best_sellers_rank": {
        "de": ["amazon bestseller-rang"],
        "en": ["best sellers rank", "amazon best sellers rank"]},
    "first_available": {"de": ["im angebot von amazon.de seit"], "en": ["date first available"]},
    "serving_size": {
        "de": ["portionsgröße", "portionsgrösse", "serviergröße"], "en": ["serving size"]},
    "asin": {"de": ["asin"], "en": ["asin"]},
}

# Canonical nutrient key -> label aliases per language.
NUTRIENT_ALIASES = {
    "saturated_fat_g": {
        "de": ["davon gesättigte fettsäuren", "gesättigte fettsäuren", "davon gesättigte"],
        "en": ["of which saturates", "saturated fat", "saturates"]},
    "sugars_g": {
        "de": ["davon zucker", "zucker"], "en": ["of which sugars", "total sugars", "sugars"]},
    "fiber_g": {"de": ["ballaststoffe"], "en": ["fibre", "dietary fiber", "fiber"]},
    "protein_g": {"de": ["eiweiß", "eiweiss", "protein"], "en": ["protein"]},
    "carbohydrates_g": {
        "de": ["kohlenhydrate"], "en": ["carbohydrate", "carbohydrates", "total carbohydrate"]},
    "fat_g": {"de": ["fett"], "en": ["total fat", "fat"]},
    "salt_g": {"de": ["salz"], "en": ["salt"]},
    "sodium_mg": {"de": ["natrium"], "en": ["sodium"]},
    "energy_kj": {"de": ["brennwert", "energie"], "en": ["energy"]},
}

# Headings of ingredient sections.
INGREDIENT_HEADINGS = {
    "de": ["zutaten", "bestandteile", "inhaltsstoffe"], "en": ["ingredients"]}

# Wrappers around a brand byline, removed in this order.
BYLINE_PATTERNS = {
    "de": [r"^marke:\s*", r"^besuche(?:n sie)? den\s*", r"-store$", r"\s*store$"],
    "en": [r"^brand:\s*", r"^visit the\s*", r"'s store$", r"\s*store$"],
}

# Review dateline.  Groups: country, then day, month, year in the
# order DATELINE_GROUPS gives; English has two shapes.
DATELINE = {
    "de": r"Bewertet in\s+(.+?)\s+am\s+(\d{1,2})\.?\s*([^\s\d]+)\s+(\d{4})",
    "en": r"Reviewed in\s+(.+?)\s+on\s+(?:([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})"
          r"|(\d{1,2})\s+([A-Za-z]+)\s+(\d{4}))",
}
DATELINE_GROUPS = {
    "de": {"day": (2,), "month": (3,), "year": (4,)},
    "en": {"day": (3, 5), "month": (2, 6), "year": (4, 7)},
}
MONTHS = {
    "de": ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august",
           "september", "oktober", "november", "dezember"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december"],
}
VERIFIED_PURCHASE = {"de": ["verifizierter kauf"], "en": ["verified purchase"]}
HELPFUL_MANY = {
    "de": "(\\d[\\d.\\s ]*)\\s*Personen fanden", "en": r"(\d[\d,\s]*)\s*people found"}
HELPFUL_ONE = {"de": r"^Eine Person fand", "en": r"^One person found"}
# Groups: percent, stars.
HISTOGRAM_LABEL = {
    "de": r"(\d+)\s*Prozent der Bewertungen haben\s*(\d)",
    "en": r"(\d+)\s*percent of reviews have\s*(\d)",
}
REVIEW_NOISE = {
    "de": ["Mehr erfahren", "Weniger anzeigen", "Bilder in dieser Rezension", "Missbrauch melden"],
    "en": ["Read more", "Show less", "Images in this review", "Report abuse"],
}
STAR_KEYS = {5: "five_star", 4: "four_star", 3: "three_star", 2: "two_star", 1: "one_star"}

# Markers of a bot-check page served with status 200.
CHALLENGE_TEXT = (
    "enter the characters you see below",
    "geben sie die zeichen unten ein",
    "type the characters you see in this image",
    "to discuss automated access to amazon data",
    "api-services-support@amazon.com",
    "sorry, we just need to make sure you",
)
CHALLENGE_TEXT_BELOW_CHARS = 120_000

# Product ids in links, and bare.
ASIN_LINK = r"/(?:dp|gp/product)/([A-Z0-9]{10})"
ASIN_BARE = r"[A-Z0-9]{10}"

# Placeholders written over session and request identifiers.
SESSION_ID = "000-0000000-0000000"
REQUEST_ID = "XXXXXXXXXXXXXXXXXXXX"
CORRELATION_ID = "00000000-0000-0000-0000-000000000000"


def aliases(table: dict, language: str) -> list[tuple[str, str]]:
    """(alias, canonical key) pairs of one language."""
    return [(alias, key) for key, by_language in table.items()
            for alias in by_language.get(language, [])]
