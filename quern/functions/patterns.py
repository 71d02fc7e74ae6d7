"""Patterns of recipe text lines (English and French)."""

_COUNT = r"(?:\(?\d+\)?\s*(?:total|items?|steps?|ingredients?|[ée]tapes?|ingr[ée]dients?)?)?"
UPPER = "A-ZÀ-ÖØ-Þ"
FRACTIONS = "¼½¾⅓⅔⅛⅜⅝⅞"

HEADING_INGREDIENTS = r"(?iU)^\s*ingr[eé]dients?\s*:?\s*(?:\d+(?:\.\d+)?\s*[x×]\s*)*" + _COUNT + r"\s*$"
HEADING_STEPS = (r"(?iU)^(?!\s*(?:step|[ée]tape)\s*\d)\s*(instructions?|directions?|method|steps?|preparation|"
                 r"pr[ée]paration|[ée]tapes?|m[ée]thode|mode\s+de\s+pr[ée]paration|marche\s+[àa]\s+suivre|"
                 r"directives?|proc[ée]dure)\s*:?\s*" + _COUNT + r"\s*$")
NUMBERED_STEP = r"^\s*\d+[\.\)]\s+"
QUANTITY_LEAD = r"(?iU)^\s*\d+[\d/\.\s]*\s*(cups?|tbsp|tsp|g|kg|oz|lb|ml|l|pinch|clove)?\b"
QTY_START = r"^\s*(\d|[" + FRACTIONS + "])"
STEP_START = r"^\s*(?:[Ss]tep\s*|[ÉéEe]tape\s*)?(\d{1,2})(?:[\.\):]\s*|\s+)(?=[" + UPPER + "])"
BARE_NUMBER = r"(?iU)^\s*(?:step\s*|[ée]tape\s*)?\d{1,2}\s*:?\s*$"
JUNK = (r"(?iU)^\s*(\d{4}-\d{2}-\d{2},?\s+\d{1,2}:\d{2}(\s*[AP]M)?|\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(\s*[AP]M)?|"
        r"page \d+ of \d+|[LJIl|\[\]_]{1,3}|(?:\S+\s+){0,4}[\w-]+\.(?:com|ca|net|org|co\.uk|io)|"
        r"\d{1,2}:\d{2}(\s+\S{1,3}){0,5}|https?://\S+|(\d+(\.\d+)?\s*[x×]\s*)+|us customary(\s+metric)?|metric|"
        r"(save|pin|print|rate|share|jump to recipe)(\s+(save|pin|print|rate|recipe|share|this))*\s*↓?|"
        r"subscribe|sign\s+(in|up)|log\s*in)\s*$")
STEPS_END = (r"(?iU)^\s*(notes?|recipe notes|nutrition(\s+information|\s+facts)?|video|equipment|did you make this.*|"
             r"course|cuisine|keyword|author|(ratings?|reviews?|comments?)(\s*\(\d+\))?|"
             r"\d+\s+(ratings?|reviews?|comments?)|valeurs?\s+nutritives?|informations?\s+nutritionnelles?|astuces?|"
             r"conseils?|(commentaires?|avis|[ée]valuations?)(\s*\(\d+\))?|(kitchen\s+)?tips?\s*>?|variations?|"
             r"recipe\s+types)\s*:?\s*$")
SIGN_OFF = (r"(?iU)^\s*(?:bonne\s+(?:cuisine|d[ée]gustation|journ[ée]e|soir[ée]e)|bon\s+app[ée]tit|[àa]\s+bient[ôo]t|"
            r"[àa]\s+la\s+prochaine|bises|bisous|gros\s+bisous|xoxo|amiti[ée]s|cordialement|merci|enjoy|happy\s+cooking|"
            r"happy\s+baking|cheers|thanks|thank\s+you|love|best|(?:best|kind|warm)\s+regards|talk\s+soon|see\s+you)"
            r"\s*[!.,]*\s*$")
GREETING = (r"(?iU)^\s*(?:salut|bonjour|bonsoir|coucou|all[ôo]|cher|ch[èe]re|chers|ch[èe]res|hi|hello|hey|dear|greetings)"
            r"(?:(?:\s+[\w'’-]+){0,3}\s*[!,:]+|\s*[!,:]*)\s*$")
COPYRIGHT = r"(?iU)^\s*(?:©|copyright\b)"
BYLINE = r"(?iU)^\s*by[:\s]"
BREADCRUMB = r"\S\s+/\s+\S.*\s+/\s+\S"
SECTION_START = r"(?iU)^(?:for the |pour la |pour le |pour les |pour l['’])"
BULLET = r"^\s*(?:[-•*·▪◦‣]\s+)+"
OCR_BULLET = r"^\s*[«»¢•·*+~]+\s+"
LINE_PRICE = r"\s+(?:\$|S(?=[O0]\.))[O0-9]{1,3}[.,][O0-9]{0,2}\.?\s*$"
LABELLED_QTY = r"(?U)^([A-Z][\w &/'()-]{0,30}):\s+(?=[\d" + FRACTIONS + "])"
MARKER = r"(?U)^\s*(?:[^\w\s]{1,2}|\w{1,3}\)|\d{1,2}[\.\)]?)\s+(?=[" + UPPER + "])"
CHECKBOX = r"^\s*(?:[LJIl|\[\]_]{1,3}|[☐□○])\s+(?=[\d" + FRACTIONS + UPPER + "])"
YIELD = (r"(?iU)^\s*\(?\s*(?:donne|makes|serves|yield(?:s)?|rendement|portions?|servings?|"
         r"pour(?=\s+\d+\s*(?:personnes?|portions?)))\s*:?\s+(.{1,60}?)\s*\)?\s*$")
WRAP_END = (r"(?iU)(?:[,\-–]|\b(?:and|or|with|of|in|into|for|the|a|an|at|room|et|ou|avec|de|du|des|d'|à|au|aux|en|pour|"
            r"le|la|les|un|une|dans|finely|thinly|roughly|coarsely|freshly|lightly|loosely|firmly|evenly|finement|"
            r"grossièrement)|(?<!,)(?<!, )\b(?:cracked|shredded|minced|grated|chopped|crushed|dried|smoked|toasted|"
            r"roasted|packed|sifted|unsalted|salted|diced|sliced|peeled|pitted|cooked|canned|whipped|softened|melted|"
            r"beaten|fresh|ground|large|small|medium|extra|virgin)|(?<!,)(?<!, )(?<![\w-])(?!half-and-half\b)\w+(?:-\w+)+)\s*$")
WRAP_TAIL = (r"(?iU)^(?:optional|divided|melted|softened|minced|diced|sliced|chopped|beaten|crushed|peeled|drained|rinsed|"
             r"halved|quartered|cubed|trimmed|thawed|separated|zested|juiced|sifted|packed|temperature|"
             r"\w+(?:é|és|ée|ées))(?:\s+\w+)?[.,]?$")
SALT_AND_PEPPER = r"(?iU)^\s*(?:salt\s+(?:and|&)\s+(?:black\s+)?pepper|sel\s+et\s+poivre)\b"
SENTENCE_END = r"[.!?]\s*$"
STEP_BREAK = r"[.!?:)]\s*$"
STEP_VERBS = """
add adjust arrange bake beat blend boil bring brown brush chill chop coat combine cook cool cover crush cut
divide drain drizzle dust fill flip fold fry garnish grate grease grill heat knead lay let line lower marinate
mash melt mix pat peel place pour preheat prepare press put reduce refrigerate remove return rinse roast roll
rub season serve set shake simmer skim slice soak spoon spread sprinkle squeeze stir strain stuff taste
thread toast top toss transfer trim turn wash whisk wipe wrap in once when while meanwhile then using make
using bake saute sear steam scoop push plate poke grind pulse sift whip
ajouter arroser assaisonner badigeonner battre beurrer chauffer couper couvrir cuire decouper deposer
dorer egoutter emincer enfourner etaler faire farcir fouetter garnir griller hacher incorporer laisser
laver mariner melanger mettre mijoter napper parsemer peler petrir placer poivrer porter prechauffer
preparer recouvrir reduire refroidir remettre remuer repartir reserver retirer rincer rouler saler
saupoudrer servir tailler trancher transferer verser dans pendant entre-temps ensuite puis lorsque quand
""".split()
SLUG_STOP = ["recipe", "recipes", "easy", "best", "the", "and", "with"]

LOG_START = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d (\w+)\s"
LOG_PROBLEMS = ["WARNING", "ERROR", "CRITICAL"]

HTML_INGREDIENTS = r"(?iU)\bingr[eé]dients?\b"
HTML_STEPS = (r"(?iU)\b(?:instructions?|directions?|method|steps?|preparation|pr[eé]paration|[eé]tapes?|m[eé]thode|"
              r"marche\s+[aà]\s+suivre|directives?|proc[eé]dure)\b")
HTML_TIME = r"(?iU)\b(?:temps|times?|min|minutes?|h|hrs?|hours?|heures?)\b"
