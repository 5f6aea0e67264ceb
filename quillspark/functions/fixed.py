"""Tables that have to equal those of other systems for right results, in their natural order."""

#: Cyrillic letters and their Latin spelling.
TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ь": "", "ю": "iu", "я": "ia", "ё": "yo", "э": "e", "ъ": "", "ы": "y",
}
#: What ids of graph entities spell otherwise.
GRAPH_LATIN = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya"}
#: Latin groups and letters and the Cyrillic letter for each, longest group first.
TO_CYRILLIC = [
    ("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("ye", "є"), ("ie", "є"), ("yu", "ю"), ("iu", "ю"), ("ya", "я"), ("ia", "я"), ("yi", "ї"),
]
SINGLE_LATIN, SINGLE_CYRILLIC = "bvhgdzklmnprstfaeiouy", "бвгґдзклмнпрстфаеіоуи"
#: Endings of Ukrainian words, tried in this order.
ENDINGS = [
    "ського", "зького", "цького", "ський", "зький", "цький", "ськими", "зькими", "цькими", "ієм", "ієві", "єві", "єм", "ого", "ої", "ові", "ою", "ами", "ими", "ах", "ням", "ів", "ям",
    "ку", "ки", "ці", "ні", "ну", "ти", "ть", "ня", "у", "ю", "і", "а", "я", "е",
]
#: Popular spellings of Latin groups in names.
POPULAR = {"kh": ["h", "x"], "zh": ["j"], "ch": ["tch"], "sh": ["sch"], "shch": ["sch"], "ts": ["tz", "c"], "ie": ["ye", "e", "je"], "iu": ["yu", "ju"], "ia": ["ya", "ja"], "h": ["kh", "g", "x"]}
#: Endings of Ukrainian names.
NAME_ENDINGS = ["ієм", "ієві", "єві", "єм", "ій", "ого", "ої", "ові", "ом", "ою", "ієї", "чі", "ча", "чу", "чею", "а", "у", "и", "і", "є"]
#: Words that are no keywords of a text, a question, an address, a link.
FREQUENCY_STOP = ["який", "якщо", "також", "this", "that", "which"]
QUERY_STOP = ["хто", "що", "який", "яка", "де", "коли", "чому", "чи", "what", "is", "are", "how", "when", "where", "who", "on", "the", "a", "an", "in", "of", "tell", "me", "about", "does", "do", "did"]
DOMAIN_STOP = ["com", "ua", "net", "org", "io", "co", "www", "http", "https"]
LINK_STOP = [
    "the", "and", "for", "with", "this", "that", "from", "have", "will", "are", "was", "were", "been", "its", "our", "your", "their", "can", "not", "but", "has", "had", "all", "also", "more", "use", "used",
    "що", "як", "де", "коли", "хто", "чому", "який", "яка", "яке", "які", "чи", "або", "та", "це", "є", "у", "в", "на", "до", "по", "про", "за", "але", "від", "при", "між", "через", "після", "перед", "над", "під",
]
#: Abbreviations and their other spellings.
ABBREVIATIONS = {
    "vpn": ["впн"], "впн": ["vpn"], "ip": ["іп"], "іп": ["ip"], "wifi": ["вайфай", "wi-fi"], "wi-fi": ["вайфай", "wifi"], "вайфай": ["wifi", "wi-fi"], "dns": ["днс"], "днс": ["dns"], "ssl": ["ссл"], "ссл": ["ssl"],
    "https": ["хттпс"], "http": ["хттп"], "hrm": ["хрм"], "хрм": ["hrm"], "crm": ["срм"], "срм": ["crm"], "erp": ["єрп"], "єрп": ["erp"], "kpi": ["кпі"], "кпі": ["kpi"], "api": ["апі"], "апі": ["api"], "ui": ["юай"], "юай": ["ui"],
}
