"""Sayings and what films really say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "n int, popular string, actual string, film string, year int, kind string, note string"
#: Popular form, what is said, film, year, kind, note.
SAYINGS = [
    ('Luke, I am your father', 'No, I am your father.', 'The Empire Strikes Back', 1980, 'misquote', None),
    ('Play it again, Sam', "Play it, Sam. Play 'As Time Goes By.'", 'Casablanca', 1942, 'misquote', None),
    ('Beam me up, Scotty', 'Scotty, beam us up.', 'Star Trek IV: The Voyage Home', 1986, 'misquote', None),
    ("We're gonna need a bigger boat", "You're gonna need a bigger boat.", 'Jaws', 1975, 'misquote', None),
    ('Mirror, mirror on the wall, who is the fairest of them all?', 'Magic mirror on the wall, who is the fairest one of all?', 'Snow White and the Seven Dwarfs', 1937, 'misquote', None),
    ('If you build it, they will come', 'If you build it, he will come.', 'Field of Dreams', 1989, 'misquote', None),
    ('Hello, Clarice', 'Good evening, Clarice.', 'The Silence of the Lambs', 1991, 'misquote', None),
    ('Do you feel lucky, punk?', "You've got to ask yourself one question: 'Do I feel lucky?' Well, do ya, punk?", 'Dirty Harry', 1971, 'misquote', None),
    ("Frankly, Scarlett, I don't give a damn", "Frankly, my dear, I don't give a damn.", 'Gone with the Wind', 1939, 'misquote', None),
    ("I'll make him an offer he can't refuse", "I'm going to make him an offer he can't refuse.", 'The Godfather', 1972, 'misquote', None),
    ("Toto, I don't think we're in Kansas anymore", "Toto, I've a feeling we're not in Kansas anymore.", 'The Wizard of Oz', 1939, 'misquote', None),
    ('Greed is good', 'Greed, for lack of a better word, is good.', 'Wall Street', 1987, 'misquote', None),
    ('Run, you fools!', 'Fly, you fools!', 'The Lord of the Rings: The Fellowship of the Ring', 2001, 'misquote', None),
    ('Life is like a box of chocolates', 'My mom always said life was like a box of chocolates.', 'Forrest Gump', 1994, 'misquote', None),
    ("Badges? We don't need no stinking badges!", "Badges? We ain't got no badges. We don't need no badges. I don't have to show you any stinking badges!", 'The Treasure of the Sierra Madre', 1948, 'misquote', None),
    ("Fasten your seatbelts, it's going to be a bumpy ride", "Fasten your seatbelts. It's going to be a bumpy night.", 'All About Eve', 1950, 'misquote', None),
    ('Me Tarzan, you Jane', 'Jane. Tarzan. Jane. Tarzan.', 'Tarzan the Ape Man', 1932, 'misquote', None),
    ('You dirty rat', 'That dirty, double-crossing rat.', 'Blonde Crazy', 1931, 'misquote', None),
    ('Win one for the Gipper', 'Win just one for the Gipper.', 'Knute Rockne All American', 1940, 'misquote', None),
    ("The first rule of Fight Club is don't talk about Fight Club", 'The first rule of Fight Club is: you do not talk about Fight Club.', 'Fight Club', 1999, 'misquote', None),
    ('Nobody puts Baby in the corner', 'Nobody puts Baby in a corner.', 'Dirty Dancing', 1987, 'misquote', None),
    ("You're a wizard, Harry", 'Yer a wizard, Harry.', "Harry Potter and the Philosopher's Stone", 2001, 'misquote', None),
    ('Keep your friends close and your enemies closer', 'Keep your friends close, but your enemies closer.', 'The Godfather Part II', 1974, 'misquote', None),
    ("These are not the droids you're looking for", "These aren't the droids you're looking for.", 'Star Wars', 1977, 'misquote', None),
    ('Snakes. Why did it have to be snakes?', "Snakes. Why'd it have to be snakes?", 'Raiders of the Lost Ark', 1981, 'misquote', None),
    ('What we have here is a failure to communicate', "What we've got here is failure to communicate.", 'Cool Hand Luke', 1967, 'misquote', None),
    ('I love the smell of napalm in the morning. It smells like victory', 'I love the smell of napalm in the morning. You know, one time we had a hill bombed for twelve hours. The smell, you know, that gasoline smell. The whole hill. Smelled like victory.', 'Apocalypse Now', 1979, 'misquote', None),
    ('Open the pod bay doors, HAL', 'Open the pod bay doors, please, HAL.', '2001: A Space Odyssey', 1968, 'misquote', None),
    ('Mrs. Robinson, are you trying to seduce me?', "Mrs. Robinson, you're trying to seduce me. Aren't you?", 'The Graduate', 1967, 'misquote', None),
    ('I ate his liver with some fava beans and a nice bottle of Chianti', 'I ate his liver with some fava beans and a nice Chianti.', 'The Silence of the Lambs', 1991, 'misquote', None),
    ('Top of the world, Ma!', 'Made it, Ma! Top of the world!', 'White Heat', 1949, 'misquote', None),
    ('Every time a bell rings, an angel gets its wings', "Every time you hear a bell ring, it means that some angel's just got his wings.", "It's a Wonderful Life", 1946, 'misquote', None),
    ("Why don't you come up and see me sometime?", "Why don't you come up sometime and see me?", 'She Done Him Wrong', 1933, 'misquote', None),
    ('Get your stinking paws off me, you damn dirty ape', 'Take your stinking paws off me, you damn dirty ape!', 'Planet of the Apes', 1968, 'misquote', None),
    ("I'm mad as hell and I'm not going to take it anymore", "I'm as mad as hell, and I'm not going to take this anymore!", 'Network', 1976, 'misquote', None),
    ('The stuff dreams are made of', 'The, uh, stuff that dreams are made of.', 'The Maltese Falcon', 1941, 'misquote', None),
    ('It puts the lotion on its skin', 'It rubs the lotion on its skin.', 'The Silence of the Lambs', 1991, 'misquote', None),
    ("Houston, we've got a problem", 'Houston, we have a problem.', 'Apollo 13', 1995, 'misquote', None),
    ("I'll be back", "I'll be back.", 'The Terminator', 1984, 'signature', 'Said first and most famously here, then quoted by half of cinema.'),
    ("I'm the king of the world", "I'm the king of the world!", 'Titanic', 1997, 'signature', 'The line everyone knows from the bow of the ship.'),
    ('No, I am your father', 'No, I am your father.', 'The Empire Strikes Back', 1980, 'signature', 'The real phrasing of the most misquoted line in film; no Luke in it.'),
    ("You know what's cooler than a million dollars? A billion dollars", "A million dollars isn't cool. You know what's cool? A billion dollars.", 'The Social Network', 2010, 'misquote', None),
    ('I have a particular set of skills', 'But what I do have are a very particular set of skills.', 'Taken', 2008, 'misquote', None),
    ("It's not personal, it's strictly business", "It's not personal, Sonny. It's strictly business.", 'The Godfather', 1972, 'misquote', None),
    ("I'm just a girl, standing in front of a boy, asking him to love her", "I'm also just a girl, standing in front of a boy, asking him to love her.", 'Notting Hill', 1999, 'misquote', None),
    ('We all go a little crazy sometimes', 'We all go a little mad sometimes.', 'Psycho', 1960, 'misquote', None),
    ('Would you like to play a game?', 'I want to play a game.', 'Saw', 2004, 'misquote', None),
    ('Like tears in the rain', 'All those moments will be lost in time, like tears in rain.', 'Blade Runner', 1982, 'misquote', None),
    ("I'm ready for my close-up, Mr. DeMille", "All right, Mr. DeMille, I'm ready for my close-up.", 'Sunset Boulevard', 1950, 'misquote', None),
    ("He's alive!", "It's alive! It's alive!", 'Frankenstein', 1931, 'misquote', None),
    ('It was beauty that killed the beast', 'It was beauty killed the beast.', 'King Kong', 1933, 'misquote', None),
    ("A man's gotta do what a man's gotta do", 'A man ought to do what he thinks is best.', 'Hondo', 1953, 'misquote', None),
    ('Please, sir, can I have some more?', 'Please, sir, I want some more.', 'Oliver!', 1968, 'misquote', None),
    ("I'm out of order? You're out of order! This whole court's out of order!", "You're out of order! You're out of order! The whole trial is out of order! They're out of order!", '...And Justice for All', 1979, 'misquote', None),
    ('Fly, my pretties, fly!', 'Now fly, fly!', 'The Wizard of Oz', 1939, 'misquote', None),
    ('Go ahead, make my day', 'Go ahead, make my day.', 'Sudden Impact', 1983, 'signature', 'Often credited to Dirty Harry; it is from the fourth film, Sudden Impact.'),
    ('Red pill or blue pill?', 'You take the blue pill... the story ends. You take the red pill... you stay in Wonderland.', 'The Matrix', 1999, 'misquote', None),
    ('You talking to me?', "You talkin' to me?", 'Taxi Driver', 1976, 'misquote', None),
    ("You talkin' to me?", "You talkin' to me?", 'Taxi Driver', 1976, 'signature', 'De Niro improvised it; the script only said Travis talks to his mirror.'),
]


def table(spark: SparkSession) -> DataFrame:
    """The sayings in their order (n)."""
    return spark.createDataFrame([(n, *s) for n, s in enumerate(SAYINGS)], SCHEMA)
