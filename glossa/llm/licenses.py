"""Licence detection by ordered signature rules: patterns behind a keyword gate, with priority and containment.

DataFrame functions only. A text is lower-cased in A-Z and reduced to its words (runs of digits, letters a-z and
characters beyond ASCII) with one blank around each, so that rules see words and nothing else. The rules are hand-written
one by one: SPDX ids, sentences of licence texts, addresses and notices, and names. A keyword of each rule gates it: a
rule's pattern only runs on texts that hold its keyword, and texts without any run none. Of overlapping detections the
containing one wins; of equal intervals the rule that comes first. The words before a name that stands say how far it is
trusted ("released under", an SPDX line, nothing).

Defined cases: null and empty texts have no words, no labels, null places and score 0; texts are scanned whole; repeated
rows get equal results; an empty table gives an empty result; other columns of docs stay, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.session import positional

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between words, before capitals are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed by the contract: the phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, gating keyword (a word that every match holds), pattern over words.
LICENCES = (
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version |v )?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:public )?(?:license )?(?:version |v )?2 0"),
    ("apache", "apache", r"apache (?:software |public )?license"),
    ("mit-0", "attribution", r"mit no attribution(?: license)?"),
    ("mit", "license", r"mit (?:expat |0 )?license"),
    ("x11", "x11", r"x11 license"),
    ("expat", "expat", r"expat license"),
    ("isc", "isc", r"isc license"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|two clause bsd|freebsd)(?: license)?(?: bsd)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|three clause bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd|four clause bsd)(?: license)?"),
    ("0bsd", "0bsd", r"0bsd(?: license)?"),
    ("bsd", "bsd", r"bsd (?:style )?license"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version |v )?3(?: 0)?(?: or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("lgpl-2.0", "lesser", r"(?:gnu )?lesser general public license (?:version |v )?2(?: 0)?(?: or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license (?:version |v )?2 1(?: or later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?(?: or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library", r"(?:gnu )?library general public license"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license (?:version |v )?1(?: 0)?(?: or later)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license (?:version |v )?2(?: 0)?(?: or later)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license (?:version |v )?3(?: 0)?(?: or later)?"),
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: license)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: license)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl license"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: (?:version |v )?1 [0-3])?"),
    ("mpl-1.0", "mozilla", r"mozilla public license (?:version |v )?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2 0"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v )?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v )?2 0"),
    ("epl", "eclipse", r"eclipse public license"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: (?:version |v )?1 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: license)?(?: (?:version |v )?1 [01])?"),
    ("cddl-1.0", "common", r"common development and distribution license(?: (?:version |v )?1 [01])?"),
    ("cpl-1.0", "common", r"common public license(?: (?:version |v )?1 0)?"),
    ("eupl-1.1", "european", r"european union public licen[cs]e (?:version |v )?1 1"),
    ("eupl-1.2", "european", r"european union public licen[cs]e (?:version |v )?1 2"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("artistic-1.0", "artistic", r"artistic license (?:version |v )?1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v )?2 0"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version |v )?1 0)?"),
    ("busl-1.1", "business", r"business source license(?: (?:version |v )?1 1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license(?: (?:version |v )?2)?"),
    ("openssl", "openssl", r"openssl license"),
    ("python-2.0", "python", r"python (?:software foundation )?license(?: (?:version |v )?2(?: 0)?)?"),
    ("php-3.0", "php", r"php license(?: (?:version |v )?3 0)?"),
    ("php-3.01", "php", r"php license (?:version |v )?3 01"),
    ("ruby", "ruby", r"ruby license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version |v )?2)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: (?:version |v )?1 1)?"),
    ("upl-1.0", "universal", r"universal permissive license(?: (?:version |v )?1 0)?"),
    ("ms-pl", "microsoft", r"microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license(?: ms rl)?"),
    ("osl-3.0", "open", r"open software license(?: (?:version |v )?3 0)?"),
    ("afl-3.0", "academic", r"academic free license(?: (?:version |v )?3 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license"),
    ("sspl-1.0", "server", r"server side public license(?: (?:version |v )?1)?"),
    ("elastic-2.0", "elastic", r"elastic license(?: (?:version |v )?2 0)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license(?: (?:version |v )?1 0)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution license(?: (?:version |v )?1 0)?"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by", "cc", r"cc by(?: [1-3] [05])?"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "commons", r"creative commons attribution(?: [1-4] [05])?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl (?:version |v )?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: or later)?(?: license)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl license"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl (?:version |v )?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version |v )?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:version |v )?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1(?: or later)?(?: license)?"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: or later)?(?: license)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl license"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl (?:version |v )?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version |v )?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:version |v )?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"gnu gpl"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: (?:version |v )?1 [123])?(?: only| or later)?"),
    ("mpl-1.0", "mpl", r"mpl (?:version |v )?1 0"),
    ("mpl-1.1", "mpl", r"mpl (?:version |v )?1 1"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v )?2 0"),
    ("epl-1.0", "epl", r"epl (?:version |v )?1 0"),
    ("epl-2.0", "epl", r"epl (?:version |v )?2 0"),
    ("edl-1.0", "edl", r"edl 1 0"),
    ("cpl-1.0", "cpl", r"cpl 1 0"),
    ("eupl-1.1", "eupl", r"eupl (?:version |v )?1 1"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v )?1 2"),
    ("artistic-1.0", "artistic", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic 2 0"),
    ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("busl-1.1", "busl", r"busl 1 1"),
    ("php-3.01", "php", r"php 3 01"),
    ("ofl-1.1", "ofl", r"ofl (?:version |v )?1 1"),
    ("upl-1.0", "upl", r"upl 1 0"),
    ("ms-pl", "pl", r"ms pl"),
    ("ms-rl", "rl", r"ms rl"),
    ("osl-3.0", "osl", r"osl (?:version |v )?3 0"),
    ("afl-3.0", "afl", r"afl (?:version |v )?3 0"),
    ("sspl-1.0", "sspl", r"sspl (?:version |v )?1(?: 0)?"),
    ("odbl-1.0", "odbl", r"odbl (?:version |v )?1 0"),
    ("bsd-2-clause", "freebsd", r"freebsd license"),
    ("public-domain", "domain", r"public domain"),
    ("reserved", "reserved", r"(?:all|no|some) rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("no-warranty", "warranty", r"without (?:any )?warranty of any kind"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
)

#: SPDX ids that are too short or common to stand without "SPDX-License-Identifier:" before them.
SPDX_IDS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("x11", "x11"), ("zlib", "zlib"), ("libpng", "libpng(?: 2 0)?"), ("openssl", "openssl"), ("ruby", "ruby"),
    ("postgresql", "postgresql"), ("ncsa", "ncsa"), ("python-2.0", "(?:python|psf) 2 0"), ("php-3.0", "php 3 0"), ("elastic-2.0", "elastic 2 0"),
    ("odc-by-1.0", "odc by 1 0"), ("apache-1.0", "apache 1 0"), ("apache-1.1", "apache 1 1"),
)

#: label, gating keyword, pattern: sentences of the licences' own texts and notices.
TEXTS = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?"),
    ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided )"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,16}nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-2.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation(?: either)? version 2"),
    ("gpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license (?:version 3 )?as published by the free software foundation(?: either)? version 3"),
    ("lgpl-2.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu (?:library|lesser) general public license as published by the free software foundation(?: either)? version 2(?! 1 )"),
    ("lgpl-2.1", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1"),
    ("lgpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3"),
    ("agpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("ncsa", "restriction", r"to deal with the software without restriction"),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", "waived", r"waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "waives", r"waives all (?:of )?(?:his or her |their )?copyright and related (?:or neighbou?ring )?rights"),
    ("ofl-1.1", "font", r"the font software may be sold as part of a larger software package"),
    ("artistic-2.0", "modified", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
)

#: label, gating keyword, pattern: addresses of licences (points and slashes are blanks here) and names that stand in package files and headers.
NOTICES = (
    ("apache-2.0", "apache", r"apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache", r"apache org licenses license 1 1(?: txt| html)?"),
    ("apache-2.0", "opensource", r"opensource org licenses? apache 2 0"),
    ("apache-2.0", "asl", r"asl (?:version |v )?2 0"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mit", "opensource", r"opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", "choosealicense", r"choosealicense com licenses mit"),
    ("mit", "terms", r"under the terms of the mit x11 license"),
    ("mit", "dual", r"dual licensed under (?:the )?mit"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource", r"opensource org licenses? bsd license(?: php)?"),
    ("bsd", "berkeley", r"berkeley software distribution license"),
    ("bsd-3-clause", "regents", r"regents of the university of california all rights reserved redistribution"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause clear(?: license)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause (?:plus )?patent(?: license)?"),
    ("isc", "opensource", r"opensource org licenses? isc(?: license)?(?: txt)?"),
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl 3 0(?: txt| html)?"),
    ("gpl", "gnu", r"gnu org licenses gpl(?: txt| html)?"),
    ("gpl", "gnu", r"gnu org copyleft gpl(?: txt| html)?"),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0(?: txt| html)?"),
    ("lgpl", "gnu", r"gnu org licenses lgpl(?: txt| html)?"),
    ("agpl-3.0", "gnu", r"gnu org licenses agpl 3 0(?: txt| html)?"),
    ("gfdl", "gnu", r"gnu org licenses fdl(?: 1 [123])?(?: txt| html)?"),
    ("gpl-2.0", "opensource", r"opensource org licenses? gpl 2 0(?: php)?"),
    ("gpl-3.0", "opensource", r"opensource org licenses? gpl 3 0(?: php)?"),
    ("lgpl-2.1", "opensource", r"opensource org licenses? lgpl 2 1(?: php)?"),
    ("lgpl-3.0", "opensource", r"opensource org licenses? lgpl 3 0(?: php)?"),
    ("agpl-3.0", "opensource", r"opensource org licenses? agpl 3 0(?: php)?"),
    ("gpl-2.0-classpath", "classpath", r"classpath exception(?: 2 0)?"),
    ("gpl-2.0-classpath", "linking", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", "gcc", r"gcc runtime library exception(?: (?:version )?3 1)?"),
    ("llvm-exception", "llvm", r"llvm exceptions?"),
    ("linux-syscall-note", "syscall", r"linux syscall note"),
    ("autoconf-exception", "autoconf", r"autoconf exception(?: [23] 0)?"),
    ("font-exception", "font", r"font exception 2 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1(?: txt| html)?"),
    ("mpl-2.0", "opensource", r"opensource org licenses? mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("edl-1.0", "eclipse", r"eclipse org (?:org documents|legal) edl v10(?: php| html)?"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "attribution", r"attribution sharealike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc", "attribution", r"attribution noncommercial [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nd", "attribution", r"attribution noderivatives [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc-sa", "attribution", r"attribution noncommercial sharealike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc-nd", "attribution", r"attribution noncommercial noderivatives [1-4] [05](?: international| unported| generic)?"),
    ("cc-by", "attribution", r"attribution 4 0 international"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("bsl-1.0", "boost", r"boost org license 1 0(?: txt)?"),
    ("zlib", "opensource", r"opensource org licenses? zlib(?: license)?(?: php)?"),
    ("cddl-1.0", "opensource", r"opensource org licenses? cddl 1 0?(?: php)?"),
    ("artistic-2.0", "opensource", r"opensource org licenses? artistic license 2 0"),
    ("python-2.0", "python", r"psf license agreement for python"),
    ("ofl-1.1", "scripts", r"scripts sil org ofl"),
    ("eupl-1.2", "joinup", r"joinup ec europa eu software page eupl"),
    ("elastic-2.0", "elastic", r"elastic co licensing elastic license"),
    ("busl-1.1", "mariadb", r"mariadb com bsl11"),
    ("sspl-1.0", "mongodb", r"mongodb com licensing server side public license"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)?(?: license)?(?: agreement)? (?:version |v )?2 1"),
    ("cecill-b", "cecill", r"cecill b(?: license)?"),
    ("cecill-c", "cecill", r"cecill c(?: license)?"),
    ("cecill", "cecill", r"cecill(?: free software)? license"),
    ("lppl-1.3", "latex", r"latex project public license(?: (?:version |v )?1 3c?)?"),
    ("lppl-1.3", "lppl", r"lppl (?:version |v )?1 3c?"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software license|psl) ?(?:version |v)?2"),
    ("blueoak-1.0.0", "blue", r"blue oak model license(?: 1 0 0)?"),
    ("bouncycastle", "bouncy", r"bouncy castle licen[cs]e"),
    ("curl", "curl", r"curl license"),
    ("imagemagick", "imagemagick", r"imagemagick license"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("unicode-dfs", "unicode", r"unicode (?:inc )?license agreement data files and software"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"the beer ware license(?: revision 42)?"),
    ("vim", "vim", r"vim license"),
    ("sleepycat", "sleepycat", r"sleepycat license"),
    ("tcl", "tcl", r"tcl tk license"),
    ("zpl-2.1", "zope", r"zope public license(?: (?:version |v )?2 [01])?"),
    ("qpl-1.0", "public", r"q public license(?: (?:version |v )?1 0)?"),
    ("ipl-1.0", "ibm", r"ibm public license(?: (?:version |v )?1 0)?"),
    ("apsl-2.0", "apple", r"apple public source license(?: (?:version |v )?2 0)?"),
    ("rpl-1.5", "reciprocal", r"reciprocal public license(?: (?:version |v )?1 5)?"),
    ("cpal-1.0", "common", r"common public attribution license(?: (?:version |v )?1 0)?"),
    ("ecl-2.0", "educational", r"educational community license(?: (?:version |v )?2 0)?"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e(?: (?:version |v )?[123] 0)?"),
    ("odc-pddl", "dedication", r"public domain dedication and license"),
    ("commons-clause", "clause", r"commons clause(?: license condition)?"),
    ("polyform-nc", "polyform", r"polyform noncommercial license(?: 1 0 0)?"),
    ("llama-community", "llama", r"llama [23](?: [0-9])? community license"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)? license"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?(?:open )?rail(?: m)? license"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "licensed", r"this software is licensed not sold"),
    ("proprietary", "reproduced", r"no part of this (?:publication|work|book) may be reproduced"),
    ("reserved", "rechte", r"alle rechte vorbehalten"),
    ("reserved", "droits", r"tous droits r[^ ]{1,2}serv[^ ]{1,2}s"),
    ("reserved", "derechos", r"todos los derechos reservados"),
    ("no-warranty", "liable", r"in no event shall the (?:authors?|copyright holders?|contributors?)(?: or (?:authors?|copyright holders?|contributors?))? be liable"),
    ("no-warranty", "merchantability", r"implied warrant(?:y|ies) of merchantability"),
)

#: How far a name is trusted, by the words right before it; a name alone has the last.
CONTEXTS = (
    (r" spdx license identifier $", 1.0),
    (r" (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?$", 0.95),
    (r" (?:subject|according|pursuant) to (?:the )?(?:terms of (?:the )?)?$", 0.8),
    (r"", 0.5),
)
#: Characters before a name that its context may take.
REACH = 100


def _spelled(core: str) -> str:
    """A pattern that takes licence for license and v2 for v 2, as words are split at blanks only."""
    return core.replace("license", "licen[cs]e").replace("(?:version |v )?", "(?:version |v ?)?").replace("licen[cs]e[cs]e", "licen[cs]e")


@lru_cache
def rules() -> tuple[tuple[str, str, str, float], ...]:
    """(label, keyword, pattern, confidence) in order of priority; a name's confidence is 0 until its context is known."""
    # One id or one of an expression: the words between are of the expression, some 400 ids long (look-behind needs a bound).
    before = r"(?<= spdx license identifier | spdx license identifier [a-z0-9 ]{1,4000} (?:or|and) )"
    spdx = [(label, "spdx", f"(?<= )(?={core} ){before}{core}(?= )", 1.0) for label, core in SPDX_IDS]
    texts = [(label, keyword, f"(?<= ){_spelled(core)}(?= )", 0.95) for label, keyword, core in (*TEXTS, *NOTICES)]
    keywords = lambda k: ("license", "licence") if k == "license" else (k,)
    named = [(label, k, f"(?<= ){_spelled(core)}(?= )", 0.0) for label, keyword, core in LICENCES for k in keywords(keyword)]
    return (*spdx, *texts, *named)


@lru_cache
def gate() -> str:
    """One pattern for a text with a rule's or base phrase's keyword, alternatives grouped by first letter."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted({k for _, k, *_ in rules()} | {"cc", "general", "reserved"}):
        by_letter.setdefault(k[0], []).append(k[1:])
    return "(?i)(?<= )(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")(?= )"


def _spaces(x: Column) -> Column:
    """Number of blanks in x."""
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _rule_table() -> Column:
    """The rules as one constant array."""
    rows = [F.struct(F.lit(i).alias("order"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern"), F.lit(trust).alias("trust")) for i, (label, keyword, pattern, trust) in enumerate(rules())]
    return F.array(*rows)


def _before(values: Column, none: int, join) -> Column:
    """For each entry, join over all entries before it: in blocks, so that work grows little faster than the array.

    An array grows by being copied, so one pass that appends to it would take time with the square of its length.
    """
    block = 64

    def inside(entries: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(entries, empty, lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, block))

    def of_blocks(some: Column) -> Column:
        totals = F.transform(some, lambda x: F.aggregate(x, F.lit(none), join))
        return F.flatten(F.zip_with(some, inside(totals, F.lit(none)), inside))

    return F.transform(F.array(blocks), of_blocks)[0]


def detections(words: Column) -> Column:
    """array<struct<start, stop, order, label, trust>> of the detections that stand, in text order; words has a blank around each."""
    fields = ("start", "minus_stop", "order", "label", "trust")

    def places(rule: Column) -> Column:
        def rows(x: Column) -> Column:
            between, found = x["between"], x["found"]
            gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda t, i: F.length(t) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
            both = F.transform(F.array(F.struct(gaps.alias("gaps"), _before(gaps, 0, lambda p, q: p + q).alias("sums"))), lambda y: F.zip_with(y["gaps"], y["sums"], lambda p, q: p + q))[0]

            def row(start: Column, i: Column) -> Column:
                ahead = F.right(F.get(between, i), F.lit(REACH))
                named = reduce(lambda rest, c: F.when(ahead.rlike(c[0]), c[1]).otherwise(rest), reversed(CONTEXTS[:-1]), F.lit(CONTEXTS[-1][1]))
                trust = F.when(rule["trust"] == 0, named).otherwise(rule["trust"])
                return F.struct(start.alias("start"), (-(start + F.length(F.get(found, i)))).alias("minus_stop"), rule["order"].alias("order"), rule["label"].alias("label"), trust.alias("trust"))

            return F.when(F.size(found) > 0, F.transform(both, row)).otherwise(F.array().cast("array<struct<start:int,minus_stop:int,order:int,label:string,trust:double>>"))

        split = F.struct(F.split(words, rule["pattern"], -1).alias("between"), F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("found"))
        return F.transform(F.array(split), rows)[0]

    present = F.array_distinct(F.regexp_extract_all(words, F.lit(gate()), F.lit(0)))
    gated = lambda held: F.filter(_rule_table(), lambda r: F.array_contains(held, r["keyword"]))
    ordered = F.array_sort(F.flatten(F.transform(F.flatten(F.transform(F.array(present), gated)), places)))

    def standing(every: Column) -> Column:
        # From the left, longer ones first and then by priority: what ends no later than an earlier one is contained in it.
        reach = _before(F.transform(every, lambda d: -d["minus_stop"]), -1, lambda p, q: F.greatest(p, q))
        kept = lambda r: F.filter(every, lambda d, i: -d["minus_stop"] > F.get(r, i))
        return F.transform(F.transform(F.array(reach), kept)[0], lambda d: F.struct(*[(-d[f]).alias("stop") if f == "minus_stop" else d[f].alias(f) for f in fields]))

    return F.transform(F.array(ordered), standing)[0]


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections is array<struct<start, stop, order, label, trust>> over the reduced text (positions in characters).
    score is the largest confidence of a standing detection. Columns of docs with these names are replaced.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    columns = docs.columns
    kept = [F.col(f"_{i}") for i, c in enumerate(columns) if c not in added]
    plain = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(F.col(f"_{columns.index(text)}"), F.lit("")), F.lit(" ")), GAP, " ")
    w, n = F.col("words"), F.col("n_words")
    first = positional(docs).select(*kept, plain.alias("words"))
    first = first.select(*kept, (_spaces(w) - 1).alias("n_words"), F.when(w.rlike(gate()), F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("words"))
    has = {p: F.coalesce(w.contains(f" {p} "), F.lit(False)) for p in BASE}
    size = {p: len(p.split(" ")) for p in BASE}
    counts = [F.when(has[p], F.regexp_count(w, F.lit(f"(?<= ){p}(?= )"))).otherwise(0).cast("long") for p in BASE]
    starts = [F.when(has[p], _spaces(F.substring_index(w, f" {p} ", 1))) for p in BASE]
    ends = [F.when(has[p], n - size[p] - _spaces(F.substring_index(w, f" {p} ", -1))) for p in BASE]
    base = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in BASE.items()]))
    found = F.when(w.isNotNull(), detections(w))
    second = first.select(*kept, "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"), base.alias("base"), found.alias("detections"))
    d, b = F.col("detections"), F.col("base")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    every = F.concat(b, F.coalesce(F.transform(d, lambda x: x["label"]), F.array().cast("array<string>")))
    score = F.coalesce(F.array_max(F.transform(d, lambda x: x["trust"])), F.lit(0.0))
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns) if c not in added]
    return second.select(*names, "n_words", "n_base", "first_word", "last_word", joined(b).alias("base_labels"), joined(every).alias("labels"), score.alias("score"), "detections")
