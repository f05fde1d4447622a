"""Word lists, labels and letter tables that results depend on."""

# Content-type labels, in tie order.
LABELS = ("сериал", "фильм", "мультфильм", "мультсериал", "прочее")
OTHER = "прочее"

# Markers of video intent, counted as substrings of the normal form.
VIDEO_MARKERS = tuple(
    """смотреть|скачать|онлайн|бесплатно|торрент|hd|full hd|1080|720|480|2160|качестве|фильм|сериал|аниме|дорама|мультфильм|
мультсериал|озвучк|сезон|серия|серии|эпизод|часть|трейлер|kinopoisk|кинопоиск|ivi|окко|more tv|moretv|wink| PREMIER|premier|
start|start.ru|阿姆|lordfilm|лордфильм|lostfilm|лостфильм|newfilm|anime|watch|online|stream""".replace("\n", "").split("|")
)

# Markers of other intent, counted likewise; one stands twice and counts twice.
OTHER_MARKERS = tuple(
    """купить|цена|заказать|доставк|магазин|отзыв|заказ|оптом|распродаж|скидк|акци|стоимость|продаж|купл|продам|скачать apk|
скачать мод|взлом|взломать|хак|cheat|hack|apk|mod |кряк|crack|keygen|serial|активатор|лицензионный ключ|крякнут|ватсап|whatsapp|
телеграм|telegram|инстаграм|instagram|тикток|tiktok|рецепт|приготов|калорий|состав|блюдо|суп|салат|выпечк|тесто|нарезк|борщ|
котлет|плов|мясо|куриц|рыб|торт|пирог|каш|варен|жарен|погод|прогноз|температур|осадк|расписани|автобус|троллейбус|маршрут|
остановк|транспорт|поезд|электричк|билет|картинк|фото|обои|скачать песн|скачать музык|скачать трек|реферат|курсов|диплом|котик|
котят|щен|собак|животн|скачать игру|играть онлайн| игр| game| games|прохожден|гайд|гайды|стрим|twitch|скачать драйвер|
скачать обновлени|скачать программ|установить программ|настройк|инструкци|аптека|больница|врач|лекарств|симптом|лечени|форум|
отзывы|аналог|аналоги|торрент клиент|торрент програм|торрент сайт|промокод|бонус|регистраци|войти|авторизац|iphone|samsung|
xiaomi|huawei|смартфон|драйвер|обновление windows|скачать windows|банк|кредит|ипотек|вклад|карт|оплат|урок|задач|домашн|школ|
универ|учеб|квартир|аренд|снять|ипотек|недвиж""".replace("\n", "").split("|")
)

# Signals of the rule that stands in for a classifier.
VIDEO_SIGNALS = ("смотреть", "скачать", "онлайн", "торрент", "сериал", "фильм", "аниме", "дорама", "мульт", "озвучк", "сезон", "серия", "hd", "1080", "720")
OTHER_SIGNALS = ("купить", "цена", "рецепт", "приготов", "скачать apk", "взлом", "погод", "расписани")

# Hints at a content type among the features.
HINTS = {
    "hint_film": ("фильм", "фильма", "картина", "кино"),
    "hint_series": ("сериал", "сериала", "дорам", "сезон", "серия"),
    "hint_anime": ("аниме", "онгоинг", "манга", "ранобэ"),
    "hint_cartoon": ("мульт", "cartoon", "анимацион"),
}
# Substrings of a query that add points to a content type.
TYPE_POINTS = (
    ("мультфильм", 5, ("мультфильм",)), ("мультсериал", 5, ("мультсериал",)), ("мультсериал", 4, ("аниме", "онгоинг")),
    ("сериал", 4, ("дорама",)), ("сериал", 4, ("сезон", "серия", "эпизод", "season", "episode")), ("сериал", 2, ("сериал",)),
    ("фильм", 2, ("фильм", "кино", "картина")),
)
SURE_TYPE_WORDS = ("аниме", "дорама", "т/с", "х/ф")

# Latin letter groups and letters with their Cyrillic reading, applied in this order.
LATIN_GROUPS = (("shch", "щ"), ("ch", "ч"), ("sh", "ш"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"), ("ie", "е"), ("ii", "ий"), ("yj", "ый"), ("iy", "ий"), ("x", "кс"))
LATIN_LETTERS = "abcdefghijklmnopqrstuvwyz"
CYRILLIC_LETTERS = "абкдефгхийклмнопкрстуввыз"

# Words that make a query generic, and those that show a search for a whole category.
GENERIC_QUERY_WORDS = tuple(
    """смотреть онлайн бесплатно фильм фильмы кино сериал сериалы мультфильм мультфильмы мультсериал аниме дорама новинки новинк
лучшие топ год года 2023 2024 2025 2026 2020 2021 2022 hd full online качестве русском русский озвучк перевод все подряд мы мой
мне меня наш ваш свой твой""".split()
)
BROAD_QUERY_WORDS = tuple("фильмы сериалы мультфильмы мультсериалы аниме дорамы новинки топ лучшие лучший русские корейские турецкие американские".split())
BROAD_CONTEXT_WORDS = tuple(
    """фильм фильмы сериал сериалы кино мультфильм мультфильмы мультсериал мультсериалы аниме дорама дорамы новинки новинка лучшие
лучший русские русское корейские турецкие американские""".split()
)

# Words that are no part of a title when they stand around it, and those that may stand inside one.
TITLE_STOP_WORDS = tuple(
    """смотреть скачать онлайн бесплатно загрузить закачать посмотреть загруз посмотр hd full hdrip bdrip webrip dvdrip hdtv 1080
720 480 2160 4k качестве качество хорошем отличном русский русская русское русско оригинал озвучка озвучк переозвучка перевод
субтитр дубляж линейка год года 2020 2021 2022 2023 2024 2025 2026 2019 2018 2017 2016 2015 фильм фильмы кино картина сериал
сериалы дорам аниме мультфильм мультфильмы мультсериал мультсериалы мульт анимацион cartoon аним сезон серия серии эпизод часть
части season episode eps kinopoisk кинопоиск ivi окко moretv wink premier start lordfilm лордфильм lostfilm лостфильм anime watch
online stream все весь всё полностью подряд торрент на телефон компьютер андроид iphone айфон пк и в с по к у о от до для а но
или же бы ли new новый новинка новинки best лучший лучшие топ сериалов фильмов мультфильмов мультсериалов анимеш анимешник манга
ранобэ малышей детей детский взрослых подростк тьмы тьма про как где когда почему зачем английский американский российский
турецкий корейский китайский японский французский немецкий режиссёр актер актёр рол главн кажд люб бесплатн без смс регистраци
магнит ссылк очень хороший крутой интересный самый какой который типо типа вроде просто прям вообще чисто глянуть видео ролик
плеер кинотеатр сайт страница официальный бесплатный fullhd qhd uhd 1080p 720p""".split()
)
TITLE_FUNCTION_WORDS = tuple("и из в во на по о с к у".split())
SEASON_WORDS = ("сезон", "season", "серия", "эпизод", "episode")

# Words of candidates that name nothing, and of the context before and after a title.
GENERIC_CANDIDATE_WORDS = tuple(
    """фильм фильмы сериал сериалы кино мультфильм мультфильмы мультсериал мультсериалы аниме дорама новинки новинка лучшие
лучший русское русский русские корейские турецкие американские онлайн смотреть скачать бесплатно""".split()
)
LEADING_WORDS = tuple("смотреть скачать фильм фильма фильмы кино сериал сериала сериалы мультфильм мультсериал аниме дорама дораму".split())
LEADING_STARTS = ("дорам", "фильм", "сериал", "аниме", "мульт")
TRAILING_WORDS = tuple(
    """смотреть скачать онлайн бесплатно торрент magnet hd hdrip bdrip webrip телефон смартфон русский русская русское озвучка озвучкой
озвучке перевод субтитры субтитрами качестве качествe узбек узбекча тилида вк tv ru net""".split()
)
TRAILING_TAIL = ("сезон", "серия", "эпизод", "season", "episode", "tv", "тв", "torrent", "magnet")

# Noise left out before a fuzzy match, and trimmed from the ends of a matched span.
FUZZY_NOISE = tuple("смотреть онлайн бесплатно скачать торрент хорошем качестве hd 720p 1080p 4k фильм сериал все серии сезон в и с".split())
SPAN_TRIM = tuple(
    """смотреть онлайн бесплатно скачать торрент хорошем качестве hd 720p 1080p 4k фильм сериал мультфильм мультсериал аниме все серии
сезон серия эпизод в и с а но на для ютуб youtube вк vk дата выхода актеры сюжет отзывы кино видео трейлер""".split()
)
# Noise words of generated training texts, chosen by the sum of a title's code points.
TEMPLATE_NOISE = ("смотреть", "онлайн", "бесплатно", "hd", "в хорошем качестве", "1080p", "")
