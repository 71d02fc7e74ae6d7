"""Word lists, unit tables and patterns that decide results.

They are plain data. Longer lists (a full produce calendar, a full table of
densities, keywords in a second language) are parameters: every operator that
reads a lexicon takes it as a DataFrame, and these are its small defaults.
"""

# --- fixed values: language guess -----------------------------------------
FRENCH_WORDS = ["et", "de", "du", "des", "la", "le", "les", "une", "avec", "tasse", "tasses", "cuillère",
                "cuillères", "c\\. à", "pincée", "faire", "ajouter", "mélanger", "cuire", "four",
                "minutes? environ"]
ENGLISH_WORDS = ["and", "the", "of", "with", "cup", "cups", "tablespoons?", "teaspoons?", "tbsp", "tsp",
                 "pinch", "add", "mix", "stir", "bake", "oven", "until"]
LANGUAGES = ["en", "fr"]

# --- fixed values: ratings, paces, categories ------------------------------
PACES = ["quick", "moderate", "long"]
DIFFICULTIES = ["easy", "medium", "hard"]
CATEGORIES = ["meal_type", "cooking_style", "main_ingredient"]
TASTE_WEIGHTS = {1: 0.8, 2: 0.9, 3: 1.0, 4: 1.1, 5: 1.2}
DIFFICULTY_WORDS = {
    "easy": "easy", "facile": "easy", "medium": "medium", "moyen": "medium", "moyenne": "medium",
    "intermediate": "medium", "hard": "hard", "difficult": "hard", "difficile": "hard",
}
SEED_TAGS = [
    ("Breakfast", "meal_type", None), ("Brunch", "meal_type", None), ("Lunch", "meal_type", None),
    ("Dinner", "meal_type", None), ("Snack", "meal_type", None), ("Cocktails", "meal_type", None),
    ("Oven", "cooking_style", None), ("Stovetop", "cooking_style", None), ("Grill", "cooking_style", None),
    ("Barbecue/Smoker", "cooking_style", None), ("Deep Fryer", "cooking_style", None),
    ("Pressure Cooker", "cooking_style", None), ("Griddle", "cooking_style", None),
    ("Shaken", "cooking_style", "cocktail"), ("Stirred", "cooking_style", "cocktail"),
    ("Built", "cooking_style", "cocktail"), ("Blended", "cooking_style", "cocktail"),
    ("Chicken", "main_ingredient", None), ("Pork", "main_ingredient", None), ("Beef", "main_ingredient", None),
    ("Fish", "main_ingredient", None), ("Vegetarian", "main_ingredient", None), ("Game", "main_ingredient", None),
]
TAG_GROUPS = ["meal_type", "cooking_style", "main_ingredient", "custom"]

# --- fixed values: limits ---------------------------------------------------
MAX_COOK_MINUTES = 60 * 24 * 60
TEXT_MAX_CHARS, TEXT_MAX_LINES, TEXT_MAX_LINE = 400_000, 4_000, 2_000
FIELD_LIMITS = {"title": 500, "servings": 100, "prep_time": 200, "cook_time": 200, "total_time": 200,
                "raw_text": 1_000_000}
ITEM_LIMITS = {"raw_line": 2000, "quantity": 100, "unit": 100, "name": 2000}
MAX_ITEMS, MAX_STEP_CHARS, MAX_URL_CHARS, MAX_TAGS, NOTES_MAX = 500, 20_000, 2_000, 50, 50_000

# --- fixed values: link keys ------------------------------------------------
TRACKING_PARAM = r"^(utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|_ga|igshid|ref|ref_src|cmpid)$"

# --- fixed values: units of an ingredient line ------------------------------
FR_SPOON = r"(?:c\.?\s*[àa]\.?\s*|cuil\.\s*[àa]\s*|cuill?(?:[eè]re|er[ée]e)s?\s+[àa]\s+)"
FR_TBSP = FR_SPOON + r"(?:soupe|table|s\.)"
FR_TSP = FR_SPOON + r"(?:th[ée]|caf[ée]|t\.|c\.)"
UNIT_WORDS = [
    FR_TBSP, FR_TSP, r"c\.\s*s\.", r"c\.\s*[ct]\.",
    "tasses?", "pinc[ée]es?", "gousses?", "bo[îi]tes?", "tranches?", "bottes?", "paquets?", "sachets?",
    "livres?", "grammes?", "kilos?", "cups?", "tbsp", "tablespoons?", "tsp", "teaspoons?", "g", "grams?", "kg",
    "kilograms?", "oz", "ounces?", "lb", "lbs", "pounds?", "ml", "milliliters?", "l", "liters?", "litres?",
    "pinch(?:es)?", "dash(?:es)?", "clove(?:s)?", "can(?:s)?", "slice(?:s)?", "stick(?:s)?", "bunch(?:es)?",
    "head(?:s)?", "package(?:s)?", "pkg", "jar(?:s)?",
]
UNIT_PATTERN = "(?:" + "|".join(UNIT_WORDS) + ")"
# canonical unit <- the spellings that mean it (whole match, any case)
CANONICAL_UNITS = {
    "cup": "cups?|tasses?", "tbsp": "tbsp|tablespoons?|" + FR_TBSP + r"|c\.\s*s\.",
    "tsp": "tsp|teaspoons?|" + FR_TSP + r"|c\.\s*[ct]\.",
    "g": "g|grams?|grammes?", "kg": "kg|kilograms?|kilos?", "oz": "oz|ounces?", "lb": "lbs?|pounds?|livres?",
    "ml": "ml|milliliters?", "l": "l|liters?|litres?", "pinch": "pinch(?:es)?|pinc[ée]es?",
    "dash": "dash(?:es)?", "clove": "cloves?|gousses?", "can": "cans?|bo[îi]tes?",
    "slice": "slices?|tranches?", "stick": "sticks?", "bunch": "bunch(?:es)?|bottes?", "head": "heads?",
    "package": "packages?|pkg|paquets?|sachets?", "jar": "jars?",
}
UNICODE_FRACTION = "[¼-¾⅐-⅞]"
QUANTITY = (r"(?:\d+\s*" + UNICODE_FRACTION + r"|\d+\s+\d+/\d+|\d+/\d+|\d+[.,]\d+|\d+|" + UNICODE_FRACTION + ")"
            r"(?:\s*(?:-|–|to)\s*\d+(?:\s+\d+/\d+|/\d+|\s*" + UNICODE_FRACTION + ")?)?")

# --- fixed values: amounts for scaling and conversion -----------------------
FRACTION_VALUES = {"¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8,
                   "⅞": 7 / 8, "⅕": 1 / 5, "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6}
FRACTION_CHARS = "".join(FRACTION_VALUES)
AMOUNT = (r"(?:\d+\s+\d+\s*/\s*\d+|\d+\s*[" + FRACTION_CHARS + r"]|\d+\s*/\s*\d+|[" + FRACTION_CHARS
          + r"]|\d+(?:[.,]\d+)?)")
AMBIGUOUS_THOUSANDS = r"^\d{1,3}[.,]\d{3}$"
SECOND_AMOUNT = (r"(?i)^\s*[a-zA-ZÀ-ÿ.]+\.?\s*(?:\+|plus\b|and\b|et\b)?\s*(?!0+\s)\d+(?:[.,/]\d+)?\s*(?!%)[a-zA-ZÀ-ÿ]")
US_CUP_ML = 236.588
# cups in one of each canonical volume unit; French cups and spoons are metric
VOLUME_UNITS = [
    (r"(?:" + FR_SPOON + r"(?:soupe|table|s\.?)|c\.\s*s\.|cs)(?![\w])", 15 / US_CUP_ML),
    (r"(?:" + FR_SPOON + r"(?:th[ée]|the|caf[ée]|t\.?|c\.?)|c\.\s*[tc]\.|ct)(?![\w])", 5 / US_CUP_ML),
    (r"tasses?(?![\w])", 250 / US_CUP_ML),
    (r"(?:cups?|c\.(?!\s*(?:[àa](?![\w])|[stc]\.)))(?![\w])", 1.0),
    (r"(?:tablespoons?|tbsps?\.?|tbs\.?|tbl\.?|tblsp\.?)(?![\w])", 1 / 16),
    (r"(?:teaspoons?|tsps?\.?)(?![\w])", 1 / 48),
    (r"(?:fl\.?\s?oz\.?|fluid\s+ounces?)(?![\w])", 1 / 8),
    (r"(?:ml|mls|millilit(?:er|re)s?)(?![\w])", 1 / US_CUP_ML),
    (r"(?:l|lit(?:er|re)s?)(?![\w'’])", 1000 / US_CUP_ML),
]
# single letters, case matters
VOLUME_LETTERS = [(r"C(?=\s)", 1.0), (r"T(?=\s)", 1 / 16), (r"t(?=\s)", 1 / 48)]
WEIGHT_UNITS = [
    (r"(?:kg|kilos?|kilogram(?:me)?s?)(?![\w])", 1000.0),
    (r"(?:g|gr\.?|grams?|grammes?)(?![\w])", 1.0),
    (r"(?:oz\.?|ounces?|onces?)(?![\w])", 28.3495),
    (r"(?:lbs?\.?|pounds?|livres?)(?![\w])", 453.592),
]
NAME_END = r"(?i)[,(;/]|\s(?:or|ou|and|et|plus)\s"
# grams in one US cup; None: known, but not weighed
GRAMS_PER_CUP = [
    ("flour", 120.0), ("bread flour", 120.0), ("cake flour", 120.0), ("whole wheat flour", 113.0),
    ("farine", 120.0), ("sugar", 198.0), ("brown sugar", 213.0), ("sucre", 198.0), ("butter", 226.0),
    ("beurre", 226.0), ("honey", 336.0), ("miel", 336.0), ("milk", 227.0), ("lait", 227.0), ("water", 227.0),
    ("eau", 227.0), ("rice", 198.0), ("riz", 198.0), ("olive oil", 200.0), ("oil", 198.0), ("ice cream", None),
    ("cream of tartar", None),
]

# --- fixed values: tail words of ingredient lines ----------------------------
INGREDIENT_TAIL = (r"(?iU)\b(to taste|for serving|to serve|for garnish|to garnish|for dusting|optional|as needed|"
                   r"au go[uû]t|pour servir|pour garnir|pour d[ée]corer|facultatif|au besoin|"
                   r"en quantit[ée] suffisante|pour (?:la )?friture|for frying|for deep[- ]frying)\b")
NO_AMOUNT_OK = (r"(?iU)\b(to taste|as needed|for serving|for garnish|optional|pinch|dash|au go[uû]t|au besoin|"
                r"pour servir|pour garnir|facultatif|une pinc[ée]e|un trait)\b")
HAS_AMOUNT = (r"(?iU)[\d¼½¾⅓⅔⅛⅜⅝⅞]|\b(a|an|one|two|three|four|five|six|half|un|une|deux|trois|quatre|cinq|six|"
              r"demi)\b")

# --- fixed values: keyword tagging (English; other languages are rows) --------
TAG_KEYWORDS = [
    ("main_ingredient", "Chicken", ["chicken", "poultry", "hen", "poulet", "volaille"]),
    ("main_ingredient", "Pork", ["pork", "bacon", "ham", "prosciutto", "sausage", "chorizo", "pancetta", "porc",
                                 "jambon"]),
    ("main_ingredient", "Beef", ["beef", "steak", "brisket", "ground beef", "short rib", "oxtail", "chuck",
                                 "blade roast", "pot roast", "prime rib", "ribeye", "rib eye", "sirloin",
                                 "flank steak", "boeuf"]),
    ("main_ingredient", "Fish", ["salmon", "tuna", "cod", "halibut", "tilapia", "shrimp", "fish", "shellfish",
                                 "crab", "lobster", "trout", "mackerel", "sardine", "sardines", "anchovy",
                                 "anchovies", "prawn", "prawns", "mussel", "mussels", "moules", "clam", "clams",
                                 "oyster", "oysters", "scallop", "scallops", "squid", "calamari", "octopus",
                                 "haddock", "sea bass", "snapper", "poisson", "saumon", "thon"]),
    ("main_ingredient", "Game", ["venison", "elk", "rabbit", "duck", "pheasant", "boar", "bison", "canard"]),
    ("cooking_style", "Oven", ["oven", "bake", "baked", "baking", "roast", "roasted", "broil", "au four",
                               "le four", "du four"]),
    ("cooking_style", "Stovetop", ["sauté", "saute", "simmer", "stovetop", "skillet", "pan-fry", "pan fry"]),
    ("cooking_style", "Grill", ["grill", "grilled", "grilling"]),
    ("cooking_style", "Barbecue/Smoker", ["smoker", "smoked", "barbecue", "bbq", "low and slow"]),
    ("cooking_style", "Deep Fryer", ["deep fry", "deep-fry", "deep fried", "fryer"]),
    ("cooking_style", "Pressure Cooker", ["pressure cook", "instant pot", "instapot"]),
    ("cooking_style", "Griddle", ["griddle", "flat top"]),
    ("cooking_style", "Shaken", ["shake well", "shaken", "cocktail shaker"]),
    ("cooking_style", "Stirred", ["stir well", "stirred", "stir with ice", "bar spoon"]),
    ("cooking_style", "Built", ["build in glass", "build the drink", "straight into the glass"]),
    ("cooking_style", "Blended", ["blender", "blended", "frozen drink"]),
    ("meal_type", "Breakfast", ["breakfast", "pancake", "omelette", "omelet", "waffle"]),
    ("meal_type", "Brunch", ["brunch"]),
    ("meal_type", "Lunch", ["lunch"]),
    ("meal_type", "Dinner", ["dinner", "entree", "entrée", "main course", "souper"]),
    ("meal_type", "Snack", ["snack", "appetizer", "finger food"]),
    ("meal_type", "Cocktails", ["cocktail", "gin", "vodka", "whiskey", "whisky", "rum", "tequila", "bitters",
                                "vermouth", "liqueur"]),
]
MEAT_TAGS = ["Chicken", "Pork", "Beef", "Fish", "Game"]
NOT_VEGETARIAN = ["lamb", "mutton", "veal", "goat", "turkey", "quail", "goose", "venison", "gelatin", "gelatine",
                  "lard", "suet", "fish sauce", "oyster sauce", "bone broth", "bone marrow", "agneau", "mouton",
                  "veau", "dinde", "caille", "oie", "saindoux"]
FLAVOURING = (r"\b(chicken|beef|pork|veal|turkey|ham|bone|fish|oyster|clam|shrimp|prawn|anchovy|crab|lobster)"
              r"\s+(stock|broth|bouillon|base|sauce|paste|cubes?|consomme|fat|drippings|juice)\b"
              r"|\b(bouillon|fond|fumet|consomme|sauce|graisse|gras|jus|cube|cubes)\s+(?:de\s+|d'|aux\s+|au\s+|a\s+la\s+)?"
              r"(poulet|volaille|boeuf|veau|porc|jambon|poisson|huitres?|crevettes?|homard|palourdes?|canard|bacon|os)\b")
BAKING_TIN = (r"\bmoules?\s+(?:(?:a|de|en|pour)\s+)?(?:gateaux?|tartes?|tartelettes?|cakes?|muffins?|madeleines?|"
              r"brioches?|pains?|quiches?|flans?|silicone|charniere|rond|ronde|carre|carree|rectangulaire|beurres?|"
              r"\d+(?:[.,]\d+)?\s*cm)\b")

# --- fixed values: produce calendar (name, months; no months = never counted) --
PRODUCE = [
    ("asparagus", [5, 6]), ("asperge", [5, 6]), ("strawberry", [6, 7, 8, 9, 10]), ("strawberries", [6, 7, 8, 9, 10]),
    ("fraise", [6, 7, 8, 9, 10]), ("green onion", [7, 8]), ("zucchini", [7, 8]), ("courgette", [7, 8]),
    ("carrot", [7, 8, 9, 10, 11]), ("carotte", [7, 8, 9, 10, 11]), ("raspberry", [7, 8, 9]),
    ("raspberries", [7, 8, 9]), ("blueberry", [7, 8]), ("blueberries", [7, 8]), ("bleuet", [7, 8]),
    ("lettuce", [7, 8]), ("laitue", [7, 8]), ("broccoli", [7, 8, 9]), ("cucumber", [7, 8]),
    ("cauliflower", [7, 8, 9]), ("chou-fleur", [7, 8, 9]), ("celery", [8, 9]), ("cabbage", [8, 9]), ("chou", [8, 9]),
    ("red cabbage", [8, 9]), ("eggplant", [8, 9]), ("aubergine", [8, 9]), ("leek", [9]), ("poireau", [9]),
    ("beet", [9]), ("betterave", [9]), ("tomato", [9]), ("tomate", [9]), ("cherry tomato", [9]), ("pumpkin", [10]),
    ("citrouille", [10]), ("cranberry", [10]), ("cranberries", [10]), ("squash", [10, 11]),
    ("butternut squash", [10, 11]), ("courge", [10, 11]), ("apple", [9, 10]), ("pomme", [9, 10]),
    ("sweet potato", [11, 12]), ("patate douce", [11, 12]), ("potato", []), ("pomme de terre", []),
    ("pommes de terre", []), ("mushroom", []), ("onion", []), ("oignon", []), ("garlic", []), ("ail", []),
    ("tomato paste", []), ("tomato sauce", []), ("apple cider", []), ("celery salt", []), ("echalote", [7, 8]),
    ("echalote francaise", []),
]
PRESERVED = (r"(?:^|[^a-z0-9])(?:frozen|canned|tinned|cans?|tins?|jars?|boites?|pots?|dried|dehydrated|jarred|pickled|"
             r"jam|jelly|preserves|juice|powder|concentrate|surgelee?s?|congelee?s?|en conserve|en boite|sechee?s?|"
             r"deshydratee?s?|en pot|marinee?s?|confiture|gelee|jus|poudre|concentre)(?![a-z0-9])")

# --- fixed values: messages and links -----------------------------------------
URL_IN_TEXT = r"https?://[^\s<>\"')]+"
CLIENT_FOOTER = (r"(?im)^\s*(get outlook for (ios|android)|sent from (my |outlook|yahoo|mail for windows|gmail|samsung|"
                 r"proton)).*$")
MAX_LINKS_TRIED = 3
MIN_MESSAGE_CONFIDENCE = 50

# --- fixed values: spreadsheets -------------------------------------------------
FORMULA_START = "(?s)^[    　]*[=+\\-@\t\r\n＝＋－＠].*"

# --- fixed values: ranking --------------------------------------------------------
COLUMN_WEIGHTS = {"title": 10.0, "raw_text": 1.0, "tags_text": 5.0, "content_text": 3.0, "notes": 2.0}
BM25_K1, BM25_B = 1.2, 0.75
MAX_QUERY_WORDS, MAX_CORRECTIONS, EXCERPT_TOKENS = 12, 3, 10
MARK_START, MARK_END = "\u0002", "\u0003"

# --- fixed values: learning -------------------------------------------------------
HASH_COLUMNS = 2 ** 15
MATCH_SHARE, TITLE_SHARE, COVERAGE = 0.75, 0.8, 0.5
PSEUDO_WEIGHT, MIN_IMPORTED, MIN_GAIN = 0.3, 8, 0.05
PRECISION, MIN_HITS, FLOOR, MIN_POSITIVE, MIN_NEGATIVE, MAX_TAG_MODELS = 0.85, 3, 0.5, 5, 5, 50
UNSURE_BELOW = 0.6
TOLERANCE = 0.02
