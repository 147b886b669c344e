"""Values that results depend on: types, keyword lists, name pools, weights. Fixed values, stated as they are."""

# Detectors in their order, and the prefix of each type's tokens.
DETECTORS = (
    "email", "fio", "phone", "inn", "card", "passport", "department_code", "cvv", "pin", "driver_license", "date", "cardholder", "address", "birth_place",
    "citizenship", "passport_issuer",
)
TOKEN_PREFIXES = {"FULL_NAME": "PERSON", "CARD_NUMBER": "CARD"}
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")

# Forms in which a person is mentioned. S, F, P: surname, given name and patronymic as words; s, f, p: as initials.
FORMS = ("SFP", "FPS", "FS", "SF", "FP", "fpS", "Sfp", "fS")

# Weights of the taxpayer number's check digits.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

# Months in the genitive.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")

# Keywords that a detector wants near its match.
PASSPORT_NEAR = ("паспорт",)
DEPARTMENT_NEAR = ("подразделени",)
CVV_NEAR = ("cvv", "cvc", "код безопасности")
PIN_NEAR = ("пин", "pin")
LICENSE_NEAR = ("водительск", "удостоверени", "в/у")
BIRTH_NEAR = ("дата рождения", "рожден", "родился", "родилась")
ISSUE_NEAR = ("дата выдачи", "выдан", "выдана", "выдано")

# Context keywords.
ROLES = (
    "клиент", "клиента", "клиенту", "клиентом", "клиенте", "заемщик", "заёмщик", "заемщика", "заёмщика", "заемщику", "заёмщику", "заявитель", "заявителя",
    "заявителю", "страхователь", "страхователя", "страхователю", "застрахованный", "застрахованного", "застрахованному", "держатель", "держателя", "держателю",
    "получатель", "получателя", "получателю", "созаемщик", "созаёмщик", "созаемщика", "созаёмщика", "пользователь", "пользователя", "пользователю",
)
ACTIONS = (
    "обратился", "обратилась", "обратились", "подал заявку", "подала заявку", "подали заявку", "оформил", "оформила", "оформили", "зарегистрирован",
    "зарегистрирована", "зарегистрированы", "проживает", "проживают", "проживал", "проживала", "сообщил", "сообщила", "сообщили", "указал", "указала", "указали",
)
BANK_CONCEPTS = ("кредит", "ипотек", "договор", "полис", "счет", "счёт", "заявление")
STRONG_PII = ("паспорт", "телефон", "email", "e-mail", "почта", "инн", "карт", "cvv", "пин", "дата рождения", "адрес проживания", "адрес регистрации")
PUBLIC_MARKERS = (
    "поэт", "писатель", "автор", "ученый", "учёный", "композитор", "актер", "актёр", "историческая личность", "написал", "написала", "создал", "создала",
    "произведение", "биография", "роман", "стихотворение", "космонавт", "изобрел", "изобрёл", "открыл", "основал",
)
ORGANIZATION_ADDRESS = ("офис", "отделени", "филиал", "банкомат", "магазин", "штаб-квартир", "представительств", "точка продаж", "точке продаж")
PERSONAL_ADDRESS = (
    "проживает", "проживал", "проживала", "зарегистрирован", "зарегистрирована", "адрес клиента", "адрес проживания", "адрес регистрации", "домашний адрес",
    "место жительства", "прописан", "прописана",
)
PUBLIC_SURNAMES = (
    "пушкин", "толстой", "чехов", "менделеев", "чайковский", "гагарин", "достоевский", "есенин", "лермонтов", "ломоносов", "циолковский", "королёв", "суворов",
    "кутузов", "жуков", "рахманинов", "шостакович",
)

# Pools of surrogates.
MALE_FIRST = ("Иван", "Александр", "Дмитрий", "Алексей", "Сергей", "Михаил", "Николай", "Андрей", "Павел", "Максим", "Антон", "Юрий", "Пётр", "Лев", "Роман", "Виктор")
FEMALE_FIRST = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Екатерина", "Ирина", "Алина", "Дарья", "Светлана", "Татьяна", "Юлия", "Полина", "Виктория", "Ксения")
MALE_LAST = ("Иванов", "Петров", "Смирнов", "Кузнецов", "Соколов", "Попов", "Лебедев", "Козлов", "Новиков", "Морозов", "Волков", "Егоров", "Захаров", "Фролов")
MALE_PATRONYMIC = ("Иванович", "Александрович", "Сергеевич", "Петрович", "Алексеевич", "Михайлович", "Николаевич", "Андреевич", "Дмитриевич", "Викторович")
FEMALE_PATRONYMIC = ("Ивановна", "Александровна", "Сергеевна", "Петровна", "Алексеевна", "Михайловна", "Николаевна", "Андреевна", "Дмитриевна", "Викторовна")
CITIES = ("Москва", "Санкт-Петербург", "Казань", "Екатеринбург", "Новосибирск", "Самара", "Воронеж", "Пермь")
STREETS = ("Ленина", "Мира", "Гагарина", "Садовая", "Советская", "Победы", "Лесная", "Центральная")
COUNTRIES = (
    "Россия", "Российская Федерация", "Беларусь", "Казахстан", "Армения", "Кыргызстан", "Узбекистан", "Таджикистан", "Азербайджан", "Молдова", "Туркменистан", "Грузия",
)
EMAIL_LOCALS = ("ivan", "alex", "maria", "anna", "dmitry", "client", "user", "info")
EMAIL_DOMAINS = ("mail.ru", "example.com", "yandex.ru", "inbox.ru", "gmail.com")
ISSUERS = ("ГУ МВД России по г.", "УМВД России по г.", "Отделом МВД России по г.")
