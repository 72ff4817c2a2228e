"""Signature rules of the licence scan.

A rule is (keyword, pattern, label, priority, confidence). Patterns match a text of lower-case words joined by single blanks. A licence's own
pattern is written by hand below; four forms of mention (tag, web address, grant, bare name) make a rule each from it.
"""

# Label, keyword that any match contains, names of the licence in words.
LICENSES = (
    ("0bsd", "bsd", "(0bsd|bsd zero clause( license)?|zero clause bsd( license)?)"),
    ("aal", "attribution", "attribution assurance license"),
    ("afl-3", "academic", "academic free licen[cs]e( version| v)? ?3( 0)?"),
    ("agpl-3", "affero", "(gnu )?affero general public licen[cs]e( version| v)? ?3( 0)?"),
    ("agpl-3", "agpl", "(gnu )?agpl ?v?3( 0)?( only| or later)?"),
    ("apache-1.1", "apache", "apache( software)? licen[cs]e( version| v)? ?1 1"),
    ("apache-2", "apache", "apache( software)? licen[cs]e( version| v)? ?2( 0)?"),
    ("apache-2", "apache", "apache v?2( 0)?( license)?"),
    ("apsl-2", "apple", "apple public source licen[cs]e( version| v)? ?2( 0)?"),
    ("artistic-1", "artistic", "artistic licen[cs]e( version| v)? ?1( 0)?"),
    ("artistic-2", "artistic", "artistic licen[cs]e( version| v)? ?2( 0)?"),
    ("beerware", "beer", "beer ?ware licen[cs]e"),
    ("bsd-2", "bsd", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( licen[cs]e)?"),
    ("bsd-3", "bsd", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( licen[cs]e)?"),
    ("bsd-4", "bsd", "(bsd 4 clause|4 clause bsd|original bsd|old bsd)( licen[cs]e)?"),
    ("bsl-1", "boost", "boost software licen[cs]e( version| v)? ?1( 0)?"),
    ("busl-1.1", "business", "business source licen[cs]e( version| v)? ?1 1"),
    ("cc-by", "by", "cc by [1-4] [05]"),
    ("cc-by", "attribution", "creative commons attribution [1-4] [05]"),
    ("cc-by-nc", "nc", "cc by nc( [1-4] [05])?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial( [1-4] [05])?"),
    ("cc-by-nc-nd", "nd", "cc by nc nd( [1-4] [05])?"),
    ("cc-by-nc-nd", "noderiv", "creative commons attribution noncommercial noderiv(ative)?s( [1-4] [05])?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa( [1-4] [05])?"),
    ("cc-by-nc-sa", "sharealike", "creative commons attribution noncommercial sharealike( [1-4] [05])?"),
    ("cc-by-nd", "nd", "cc by nd( [1-4] [05])?"),
    ("cc-by-nd", "noderiv", "creative commons attribution noderiv(ative)?s( [1-4] [05])?"),
    ("cc-by-sa", "sa", "cc by sa( [1-4] [05])?"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike( [1-4] [05])?"),
    ("cc0-1", "cc0", "cc0( 1 0)?( universal)?"),
    ("cddl-1", "common", "common development and distribution licen[cs]e( version| v)? ?1( [01])?"),
    ("cecill-2", "cecill", "cecill( licen[cs]e)?( version| v)? ?2( [01])?"),
    ("clartistic", "clarified", "clarified artistic licen[cs]e"),
    ("cpal-1", "common", "common public attribution licen[cs]e( version| v)? ?1( 0)?"),
    ("cpl-1", "common", "common public licen[cs]e( version| v)? ?1( 0)?"),
    ("ecl-2", "educational", "educational community licen[cs]e( version| v)? ?2( 0)?"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e( version| v)? ?1( 0)?"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e( version| v)? ?2( 0)?"),
    ("eupl-1.2", "european", "european union public licen[cs]e( version| v)? ?1 2"),
    ("fdl-1.3", "documentation", "(gnu )?free documentation licen[cs]e( version| v)? ?1 3"),
    ("gpl-1", "general", "(gnu )?general public licen[cs]e( version| v)? ?1( 0)?"),
    ("gpl-2", "general", "(gnu )?general public licen[cs]e( version| v)? ?2( 0)?"),
    ("gpl-2", "gpl", "(gnu )?gpl ?v?2( 0)?( only| or later)?"),
    ("gpl-3", "general", "(gnu )?general public licen[cs]e( version| v)? ?3( 0)?"),
    ("gpl-3", "gpl", "(gnu )?gpl ?v?3( 0)?( only| or later)?"),
    ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("isc", "isc", "isc licen[cs]e"),
    ("lgpl-2", "library", "(gnu )?library general public licen[cs]e( version| v)? ?2( 0)?"),
    ("lgpl-2.1", "lesser", "(gnu )?lesser general public licen[cs]e( version| v)? ?2 1"),
    ("lgpl-2.1", "lgpl", "(gnu )?lgpl ?v?2 1( only| or later)?"),
    ("lgpl-3", "lesser", "(gnu )?lesser general public licen[cs]e( version| v)? ?3( 0)?"),
    ("lgpl-3", "lgpl", "(gnu )?lgpl ?v?3( 0)?( only| or later)?"),
    ("lppl-1.3", "latex", "latex project public licen[cs]e( version| v)? ?1 3c?"),
    ("mit", "mit", "(mit|mit x11|mit expat) licen[cs]e"),
    ("mit", "expat", "expat licen[cs]e"),
    ("mit-0", "mit", "(mit 0|mit no attribution)( licen[cs]e)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e( version| v)? ?1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e( version| v)? ?2( 0)?"),
    ("mpl-2", "mpl", "mpl ?v?2( 0)?"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("mulan-2", "mulan", "mulan permissive software licen[cs]e( version| v)? ?2"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)? licen[cs]e"),
    ("odbl-1", "database", "open (data commons open )?database licen[cs]e( version| v)? ?1( 0)?"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e"),
    ("ofl-1.1", "font", "(sil )?open font licen[cs]e( version| v)? ?1 1"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("osl-3", "open", "open software licen[cs]e( version| v)? ?3( 0)?"),
    ("php-3", "php", "php licen[cs]e( version| v)? ?3( 01?)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("psf-2", "python", "python software foundation licen[cs]e( version| v)? ?2?"),
    ("public-domain", "public", "(in|into|to) the public domain"),
    ("qpl-1", "q", "q public licen[cs]e( version| v)? ?1( 0)?"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("sspl-1", "server", "server side public licen[cs]e( version| v)? ?1"),
    ("unlicense", "unlicen", "unlicen[cs]e"),
    ("upl-1", "universal", "universal permissive licen[cs]e( version| v)? ?1( 0)?"),
    ("vim", "vim", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c( software)? licen[cs]e"),
    ("wtfpl", "wtfpl", "wtfpl( version| v)? ?2?"),
    ("x11", "x11", "x11 licen[cs]e"),
    ("zlib", "zlib", "zlib( libpng)? licen[cs]e"),
    ("zpl-2.1", "zope", "zope public licen[cs]e( version| v)? ?2( [01])?"),
)

# Characteristic sentences of licence texts: label, keyword, words.
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl-2", "either", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "either", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "either", "either version 2 1 of the license or at your option any later version"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "eclipse", "accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("cc0-1", "waived", "has waived all copyright and related or neighboring rights"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
)

# The phrases counted as base places.
BASE = (
    ("mit", "mit", "under the mit license"),
    ("apache-2", "apache", "apache license version 2"),
    ("cc-by-nc", "nc", "cc by nc"),
)

# Any text with a match has one of these (before its words are taken apart).
GATE = r"(?i)licen[cs]|spdx|(?<![0-9A-Za-z\x{80}-\x{10FFFF}])cc(0|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by)|creative|gpl|apache|permission|redistribution|endorse|advertising|altered|unencumbered|waived|reserved|domain|mpl|bsd|wtfpl|disclaimer|the[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+fuck|mit[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(0|no)|cecill"

# Form of mention: words around the name, priority, confidence.
FORMS = (
    ("spdx licen[cs]e identifier {}", 90, 1.0),
    ("(licenses|org licenses|org licenses by) {}", 70, 0.9),
    ("(licen[cs]ed|released|distributed|available|published|provided|dedicated)( in| as)?( under| with)?( the terms of)?( an?| the| either the)? {}", 80, 0.95),
    ("{}", 50, 0.8),
)


def rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """(rule, keyword, pattern, label, priority, confidence, is_base). A pattern starts at the blank before its first word and ends before a blank."""
    found = [(keyword, words, label, 0, 0.9, True) for label, keyword, words in BASE]
    found += [(keyword, words, label, 100, 1.0, False) for label, keyword, words in SENTENCES]
    found += [(keyword, form.format(words), label, priority, confidence, False) for form, priority, confidence in FORMS for label, keyword, words in LICENSES]
    return [(i, keyword, f" {words}(?= )", label, priority, confidence, base) for i, (keyword, words, label, priority, confidence, base) in enumerate(found)]
