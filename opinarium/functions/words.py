"""Fixed values of the comment cleaner."""

# Phrases of bloggers' and social noise (patterns, as they are), in order.
NOISE_PHRASES = [
    "мои соц сети", "мои соц. сети", "подпишись", "подписывайтесь", "ставь лайк", "ставьте лайк", "не забудьте подписаться", "поддержать канал",
    "поддержать меня", "делаю обзоры магазинов", "смотрите полное видео", "полная версия на канале", "мой instagram", "мой инстаграм", "telegram-канал", "телеграм-канал",
    "dzen.ru", "дзен -", "youtube.com", "vk.com", "tiktok.com", "tiktok-", "insta:", "instagram:",
]

# Russian stop words.
STOP_WORDS = [
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы",
    "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "теперь", "когда", "даже", "ну", "вдруг",
    "ли", "если", "уже", "или", "ни", "быть", "был", "него", "до", "вас", "нибудь", "опять", "уж", "вам", "ведь", "там", "потом", "себя", "ничего",
    "ей", "может", "они", "тут", "где", "есть", "надо", "ней", "для", "мы", "тебя", "их", "чем", "была", "сам", "чтоб", "без", "будто", "чего", "раз",
    "тоже", "себе", "под", "будет", "ж", "тогда", "кто", "этот", "того", "потому", "этого", "какой", "совсем", "ним", "здесь", "этом", "один",
    "почти", "мой", "тем", "чтобы", "нее", "сейчас", "были", "куда", "зачем", "всех", "никогда", "можно", "при", "наконец", "два", "об", "другой",
    "хоть", "после", "над", "больше", "тот", "через", "эти", "нас", "про", "них", "какая", "много", "разве", "сказал", "три", "эту", "моя", "впрочем",
    "хорошо", "свою", "этой", "перед", "иногда", "лучше", "чуть", "том", "нельзя", "такой", "им", "более", "всегда", "конечно", "всю", "между",
]

# Fixed value: characters that become spaces.
PUNCTUATION = "«»“”\"'`´,()=><"

# Placeholders for a profile without a brand, and for topics.
DEFAULT_BRAND = ["(brand|brands)"]
TOPICS = {"Topic1": ["key_word11", "key-word12"], "Topic2": ["key_word21", "key-word22"]}

# Patterns of sure drops that hold for any brand, and marks of official replies.
HIRING_PATTERNS = [
    r"(?i)\bваканси\w+\b", r"(?i)\bтребу(ется|ются)\b", r"(?i)\bподработк\w+\b", r"(?i)\bработа\b", r"(?i)\bмерченда(й|и)зер\b", r"(?i)\bпродав(ец|цы)\b",
    r"(?i)\bкассир\w*\b", r"(?i)\bуборщиц\w*\b", r"(?i)\bгрузчик\w*\b",
]
EVENT_PATTERN = r"(?i)\b(мастер\-класс|ярмарка|встреча|концерт|афиша|мероприятие)\b.{0,60}\b(рядом|около|возле|напротив)\b"
NEAR_PATTERN = r"(?i)\b(рядом|около|возле|напротив)\b.{{0,40}}\b({names})\b"
REPLY_MARKERS = [r"(?i)^здравствуйте", r"(?i)^добрый\s+день", r"(?i)спасибо\s+за\s+обращение", r"(?i)нам\s+очень\s+приятно", r"(?i)приходите\s+еще"]
