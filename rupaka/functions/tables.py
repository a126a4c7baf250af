"""Default rule tables and word lists. Every operator takes its own in their place."""

from __future__ import annotations

# They decide which analyses exist and how they are labelled.

#: Paradigm: (surface suffix, lemma suffix, gender, number, case), in match order.
NOUN_PARADIGMS = {
    "M1": [("ा", "ा", "M", "SG", "DIR"), ("े", "ा", "M", "PL", "DIR"), ("े", "ा", "M", "SG", "OBL"), ("ों", "ा", "M", "PL", "OBL")],
    "M2": [("", "", "M", "SG", "DIR"), ("", "", "M", "PL", "DIR"), ("", "", "M", "SG", "OBL"), ("ों", "", "M", "PL", "OBL")],
    "M3": [("ी", "ी", "M", "SG", "DIR"), ("ी", "ी", "M", "PL", "DIR"), ("ी", "ी", "M", "SG", "OBL"), ("ियों", "ी", "M", "PL", "OBL")],
    "M4": [("ू", "ू", "M", "SG", "DIR"), ("ू", "ू", "M", "PL", "DIR"), ("ू", "ू", "M", "SG", "OBL"), ("ुओं", "ू", "M", "PL", "OBL")],
    "F1": [("ी", "ी", "F", "SG", "DIR"), ("ियाँ", "ी", "F", "PL", "DIR"), ("ी", "ी", "F", "SG", "OBL"), ("ियों", "ी", "F", "PL", "OBL")],
    "F2": [("ा", "ा", "F", "SG", "DIR"), ("ाएँ", "ा", "F", "PL", "DIR"), ("ा", "ा", "F", "SG", "OBL"), ("ाओं", "ा", "F", "PL", "OBL")],
    "F3": [("", "", "F", "SG", "DIR"), ("ें", "", "F", "PL", "DIR"), ("", "", "F", "SG", "OBL"), ("ों", "", "F", "PL", "OBL")],
    "F4": [("ि", "ि", "F", "SG", "DIR"), ("ियाँ", "ि", "F", "PL", "DIR"), ("ि", "ि", "F", "SG", "OBL"), ("ियों", "ि", "F", "PL", "OBL")],
    "F5": [("ु", "ु", "F", "SG", "DIR"), ("ुएँ", "ु", "F", "PL", "DIR"), ("ु", "ु", "F", "SG", "OBL"), ("ुओं", "ु", "F", "PL", "OBL")],
}

#: Verb suffixes with the ending that their lemma gets back, in match order.
VERB_RULES = [
    ("एंगीं", ""), ("एँगीं", ""), ("येंगी", ""), ("येंगे", ""), ("जिये", ""), ("ूंगा", ""), ("ेंगे", ""), ("ूंगी", ""),
    ("ूँगी", ""), ("ूँगा", ""), ("ऊंगा", ""), ("एँगे", ""), ("ऊंगी", ""), ("ऊँगी", ""), ("ऊँगा", ""), ("ेंगी", ""),
    ("एंगी", ""), ("एंगे", ""), ("येगा", ""), ("येगी", ""), ("ुंगी", ""), ("िये", ""), ("इये", ""), ("जिए", ""),
    ("तीं", ""), ("ेगा", ""), ("ेगी", ""), ("एगा", ""), ("एगी", ""), ("ोगे", ""), ("ओगे", ""), ("ोगी", ""),
    ("ओगी", ""), ("िया", "ी"), ("िया", "े"), ("यें", ""), ("यीं", ""), ("ुया", "ू"), ("ुये", "ू"), ("ूँ", ""),
    ("ऊँ", ""), ("िए", ""), ("इए", ""), ("ता", ""), ("ती", ""), ("ते", ""), ("या", ""), ("यी", ""),
    ("ये", ""), ("एँ", ""), ("ईं", ""), ("ना", ""), ("ने", ""), ("नी", ""), ("ीं", ""), ("ें", ""),
    ("ुए", "ू"), ("ो", ""), ("ओ", ""), ("ई", ""), ("ए", ""), ("ा", ""), ("ी", ""), ("े", ""),
]

#: Irregular surface forms by lemma.
IRREGULAR = {
    "ले": "ली लो लीजिए लीजिये लीं लिया लिये लिए लूॅगा लूंगा लूॅगी लूंगी लेंगे लेंगीं",
    "दे": "दो दीजिये दीजिए दी दीं दूॅगा दूंगी देंगे दिया दिये दिए",
    "जा": "गया गयी गयीं गई गईं गये गए",
    "कर": "की कीं किया किये किए",
}

#: Morphemes whose presence in a suffix sets a feature, in order.
SUFFIX_FLAGS = [("त", "t"), ("य", "y"), ("ना", "na"), ("ने", "ne"), ("नी", "ni"), ("ग", "g"), ("ए", "y"), ("ई", "y")]
#: Morphemes that begin or end a verb's lemma, with their flags, in file order; auxiliary roots that end it.
STEM_FLAGS = [
    ("रह", "r"), ("कर", "k"), ("जा", "j"), ("आ", "a"), ("चल", "c"), ("चुक", "co"), ("रख", "co"), ("डाल", "co"), ("बैठ", "co"), ("लग", "l"), ("वाल", "v"),
    ("को", "ko"), ("चाह", "ch"), ("सक", "s"), ("पा", "p"), ("बन", "bn"), ("पड़", "md"), ("दे", "mp"),
]
AUXILIARIES = "कर रह जा आ चल चुक रख डाल बेेठ लग वाल चाह सक पा बन पड़ दे है ले था"
FLAG_FEATURES = {
    "t": {"aspect": "imperfective"},
    "g": {"tense": "future"},
    "na": {"verbal_type": "infinitive"},
    "ne": {"verbal_type": "infinitive", "case": "O"},
    "ni": {"verbal_type": "infinitive", "gender": "F"},
    "y": {"aspect": "perfective"},
}
INFINITIVES = {"ना": ("M", "S", None), "ने": ("M", "S", "O"), "नी": ("F", "S", None)}
FUTURE_GN = [("गीं", "F", "P"), ("गी", "F", "S"), ("गे", "M", "P"), ("गा", "M", "S")]
IMPERFECTIVE_GN = {"ता": ("M", "S"), "ती": ("F", "S"), "ते": ("M", "P"), "तीं": ("F", "P")}
TERMINAL_GN = [
    ("यीं", "F", "P"), ("यी", "F", "S"), ("ये", "M", "P"), ("या", "M", "S"), ("ईं", "F", "P"), ("ई", "F", "S"), ("ुईं", "F", "P"),
    ("ुई", "F", "S"), ("ुए", "M", "P"), ("ुआ", "M", "S"), ("ीं", "F", "P"), ("ी", "F", "S"), ("े", "M", "P"), ("ा", "M", "S"),
]
PERSONS = [("1", "ूंगा ूँगा ूंगी ूँगी ऊंगा ऊँगा ऊंगी ऊँगी ूं ूँ ऊं ऊँ एंगीं एँगीं"), ("2", "ोगे ओगे ोगी ओगी ोंगे ोंगी ो ओ िए िये इए इये जिये जिए")]
FUTURE = "ूंगा ूँगा ूंगी ूँगी ऊंगा ऊँगा ऊंगी ऊँगी ेगा ेगी ेंगे ेंगी एगा एगी एंगे एंगी एंगीं एँगे एँगीं येगा येगी येंगे येंगी ोगा ोगी ोगे ओगे ओगी ोंगे ोंगी"
IMPERFECTIVE = "ता ती ते तीं"
PERFECTIVE = "या यी ये यीं यें ई ईं िया ुआ ुए ुई ुईं ुये ुयी ुयीं ा ी े ीं"
IMPERATIVE = "ो ओ िए िये इए इये जिये जिए"
SUBJUNCTIVE = "ए एँ ये यें ूँ ऊँ ूं ऊं ों ें"
#: Suffixes with several readings: (aspect, mood, verbal_type, person, number, gender).
AMBIGUOUS = {
    "ए": [("perfective", None, "participle", None, "P", "M"), (None, "subjunctive", "finite", None, None, None), (None, "subjunctive", "finite", "3", "S", None)],
    "े": [("perfective", None, "participle", None, "P", "M"), (None, "subjunctive", "finite", "2", None, None)],
    "ें": [(None, "subjunctive", "finite", None, "S", None), (None, "subjunctive", "finite", None, "P", None)],
}

CLITICS = "भी ही तो"
POSTPOSITIONS = (
    "को में से ने पर तक के की का द्वारा पास साथ बिना जैसा जैसी जैसे बाद पहले आगे पीछे ऊपर नीचे अंदर बाहर बीच सामने खिलाफ अनुसार "
    "अलावा दौरान बावजूद विरुद्ध तरफ ओर तरह जगह बजाय खातिर लिए बारे रूप आधार नाम वजह तुलना मुकाबले बदले बराबर"
)
OBLIQUE_POSTPOSITIONS = (
    "को में से ने पर तक के की का द्वारा पास साथ बिना बाद पहले आगे पीछे ऊपर नीचे अंदर बाहर बीच सामने खिलाफ अनुसार "
    "अलावा दौरान बावजूद विरुद्ध तरफ ओर तरह जगह बजाय खातिर"
)
#: First word: second words; then the postpositions of three words.
COMPOUNDS = {
    "के": "लिए साथ बाद ऊपर नीचे अंदर बाहर आगे पीछे पास बीच खिलाफ बिना द्वारा अनुसार अलावा सामने दौरान बावजूद विरुद्ध बजाय बराबर",
    "की": "तरफ ओर तरह जगह बजाय खातिर",
    "से": "पहले दूर ज़्यादा ज्यादा कम लेकर अलग परे बाहर",
    "को": "छोड़कर लेकर",
}
LONG_COMPOUNDS = ["के बारे में", "के बदले में", "के आधार पर", "के रूप में", "के नाम पर", "के साथ साथ", "के मुकाबले में", "के विरोध में", "की वजह से", "की तुलना में"]
SINGULAR_QUANTIFIERS = "एक इस उस किस हर प्रत्येक"
PLURAL_QUANTIFIERS = "सब सभी कई कुछ बहुत अनेक ये वे इन उन"
GENITIVES = {"का": ("M", "SG"), "की": ("F", None), "के": ("M", None)}
NEGATIONS = {"नहीं": "nahi", "न": "nahi", "ना": "nahi", "मत": "mat"}
CONJUNCTION = "और"

VOWEL_FINALS = "ािीुूेैोौँंः" "अआइईउऊएऐओऔ" "ऄअॠॡ"
ENDING_CLASSES = {"ा": ("M1", "F2"), "े": ("M1", "F1"), "ी": ("M3", "F1"), "ि": ("M3", "F4"), "ू": ("M4", "F5"), "ु": ("M4", "F5")}
HEURISTIC_CLASSES = {"ा": "M1", "ी": "F1", "ि": "F4", "ई": "F1"}

#: Labels of the raw lexicons that stand for others, and classes of exemplar words.
LABEL_FIXES = {
    "<क्रोध": "क्रोध", "ेex_noun": "ex_noun", "गुिड़या": "गुड़िया", "लडकी": "लड़की", "अाशा": "आशा", "शािन्त": "शान्ति", "भीडञ": "भीड़", "भिड़": "भीड़",
    "रातन": "रात", "आ": "ex_noun", "बच्चा": "लड़का", "चिड़िया": "गुड़िया", "रेडिओ": "ex_noun", "फोटो": "ex_noun", "गेहूॅ": "ex_noun", "proper_noun": "ex_noun",
}
EXEMPLARS = {
    "M1": "लड़का राजा विधाता लोहा", "M2": "घर क्रोध खर्च अपनापन", "M3": "आदमी कवि पानी", "M4": "आलू शत्रु लहू बालू",
    "F1": "लड़की गुड़िया", "F2": "आशा ईर्ष्या", "F3": "रात भीड़", "F4": "शान्ति आपत्ति", "F5": "वायु ऋतु बहू",
    "IRREG": "माँ सरसों लौ कुऑ", "UNKNOWN": "ex_noun",
}

#: What the treebank's tense-aspect-modality codes assert: (field, value); the others assert nothing.
TAM = {
    "wA": ("aspect", "imperfective"), "yA": ("aspect", "perfective"), "yA1": ("aspect", "perfective"), "vA": ("aspect", "perfective"), "gA": ("tense", "future"),
    "WA": ("tense", "past"), "hE": ("tense", "present"), "eM": ("mood", "subjunctive"), "ao": ("mood", "imperative"), "aO": ("mood", "imperative"), "Uz": ("mood", "subjunctive"),
}
