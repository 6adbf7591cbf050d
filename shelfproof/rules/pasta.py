"""Fixed values of the dry pasta category: words, patterns and ranges."""

KEY = "dry_pasta"
LABEL = "dry pasta"

BREADCRUMBS = ("nudeln & pasta", "pasta & noodles")
OTHER_BREADCRUMBS = ("gekühlte pasta", "fertiggerichte", "nudelgerichte", "konserven",
                     "pastasaucen", "kühlprodukte", "refrigerated", "canned")
FRESH = r"\bfrische\s+(?:pasta|nudeln)|\bpasta fresca\b|\bfresh pasta\b"

RAW_MATERIALS = (
    ("durum_wheat", r"hartweizen|durum|semola di grano duro|grano duro|semolina|hartweizengrie(?:ß|ss)"),
    ("wholegrain", r"vollkorn|integrale|wholegrain|whole ?wheat|wholemeal"),
    ("egg", r"\bei(?:er)?\b|eifreiland|vollei|\buovo\b|\buova\b|\begg\b"),
    ("legume", r"linsen|kichererbsen|erbsen|sojabohn|bohnen|lentil|chickpea|\blupine|edamame"),
    ("gluten_free_grain", r"maismehl|reismehl|buchweizen|quinoa|hirse|"
                          r"\bmais\b|\breis(?:mehl)?\b|corn flour|rice flour"),
)
NOT_PURE = ("egg", "legume", "gluten_free_grain")
PURE_DURUM = (r"100\s*%\s*(?:italienisch\w*\s+)?(?:hart)?weizen|"
              r"100\s*%\s*(?:semola di\s+)?grano duro|100\s*%\s*durum")

CLAIMS = (
    ("bronze_die", "Bronze die", r"bronze|trafilat[ao]\s+al\s+bronzo|bronzo"),
    ("slow_drying", "Slow drying",
     r"langsam\w*\s+(?:ge)?trockn|langzeittrocknung|lenta\s+essicc|slow[- ]dried|slow drying"),
    ("low_temperature_drying", "Low-temperature drying",
     r"niedrig\w*\s*temperatur|niedertemperatur|schonend\w*\s+(?:ge)?trockn|"
     r"bassa temperatura|low[- ]temperature"),
    ("gragnano_igp", "Pasta di Gragnano IGP",
     r"gragnano[^.]{0,40}\b(?:i\.?g\.?p|g\.?g\.?a)\b|\b(?:i\.?g\.?p|g\.?g\.?a)\b[^.]{0,40}gragnano"),
    ("italian_wheat", "Italian wheat",
     r"italienisch\w*\s+(?:hart)?weizen|weizen aus italien|"
     r"grano\s+(?:duro\s+)?(?:100%\s*)?italiano|italian durum wheat"),
    ("made_in_italy", "Made in Italy",
     r"made in italy|hergestellt in italien|in italien (?:herge|produzi)|"
     r"100\s*%\s*italien|prodotto in italia"),
)
DRYING_DETAIL = (
    ("drying_temperature", r"\b(\d{2})\s*°\s*C"),
    ("drying_hours", r"\b(\d{1,3})\s*(?:stunden|std\.?|ore|hours)\b"),
)

NUTRITION_BANDS = {
    "energy_kcal": (280.0, 420.0), "energy_kj": (1150.0, 1800.0), "protein_g": (4.0, 30.0),
    "carbohydrates_g": (35.0, 90.0), "fat_g": (0.0, 15.0), "fiber_g": (0.0, 20.0),
    "salt_g": (0.0, 5.0), "sugars_g": (0.0, 15.0), "saturated_fat_g": (0.0, 6.0),
}
PRICE_BAND = (0.80, 40.00)
