"""License scans: ordered signature rules over a text's words.

One keyword pattern lets through the texts worth reading. Those are reduced to their words (ASCII lower case, single
spaces), and in them every rule whose own keyword occurs is matched, and overlapping detections are resolved: one that
lies inside another of the same or a higher priority goes (of equal intervals the earlier rule stays). Base rules are
plain phrases; the labels they find are never suppressed.

All of it is one projection over each row, without a shuffle and without user functions. The rules are a literal of
the plan, the same for any input.

Cases: null, empty and wordless texts have no words and no detections (first_word and last_word null, score 0); very
long texts are read whole; repeated rows and ids are scanned one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, text_of


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    keywords: tuple[str, ...]
    priority: int
    score: float
    base: bool = False


LICENCE = "licen[sc]e"

#: Base phrases (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, name as words, SPDX words; versions go into the label (fixed values).
FAMILIES: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("gpl", "(?:gnu )?(?:general public|gpl)", "gpl", ("1", "2", "3")),
    ("lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl)", "lgpl", ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", "agpl", ("1", "3")),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl|fdl)", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "(?:apache(?: software)?|asl)", "apache", ("1 0", "1 1", "2 0")),
    ("mpl", "(?:mozilla public|mpl)", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "(?:eclipse public|epl)", "epl", ("1 0", "2 0")),
    ("edl", "(?:eclipse distribution|edl)", "edl", ("1 0",)),
    ("cddl", "(?:common development and distribution|cddl)", "cddl", ("1 0", "1 1")),
    ("cpl", "(?:common public|cpl)", "cpl", ("1 0",)),
    ("eupl", "(?:european union public|eupl)", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "(?:open software|osl)", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "(?:academic free|afl)", "afl", ("1 2", "2 0", "2 1", "3 0")),
    ("artistic", "(?:perl )?artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost(?: software)?|bsl", "bsl", ("1 0",)),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("ofl", "(?:sil )?(?:open font|ofl)", "ofl", ("1 0", "1 1")),
    ("zpl", "(?:zope public|zpl)", "zpl", ("1 1", "2 0", "2 1")),
    ("php", "php", "php", ("3 0", "3 01")),
    ("python", "(?:python software foundation|psf|python)", "psf", ("2 0",)),
    ("odbl", "(?:open database|odbl)", "odbl", ("1 0",)),
    ("odc-by", "(?:open data commons attribution|odc by)", "odc by", ("1 0",)),
    ("ms-pl", "(?:microsoft public|ms pl)", "ms pl", ()),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", "ms rl", ()),
    ("mit", "(?:mit x11|x11 mit|mit expat|expat|mit)", "mit", ()),
    ("x11", "x11", "x11", ()),
    ("isc", "(?:internet software consortium|isc)", "isc", ()),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause|two clause bsd)", "bsd 2 clause", ()),
    ("bsd-3-clause", "(?:modified bsd|revised bsd|new bsd|3 clause bsd|bsd 3 clause|three clause bsd)", "bsd 3 clause", ()),
    ("bsd-4-clause", "(?:original bsd|4 clause bsd|bsd 4 clause|four clause bsd)", "bsd 4 clause", ()),
    ("bsd", "bsd(?: style)?", "bsd", ()),
    ("0bsd", "(?:zero clause bsd|0bsd|bsd zero clause)", "0bsd", ()),
    ("zlib", "(?:zlib(?: libpng)?)", "zlib", ()),
    ("libpng", "libpng", "libpng", ("2 0",)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "(?:do what the fuck you want to public|wtfpl)", "wtfpl", ("1", "2")),
    ("ncsa", "(?:university of illinois ncsa(?: open source)?|ncsa)", "ncsa", ()),
    ("openssl", "openssl", "openssl", ()),
    ("ruby", "ruby", "ruby", ()),
    ("vim", "vim", "vim", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("ecl", "(?:educational community|ecl)", "ecl", ("1 0", "2 0")),
    ("upl", "(?:universal permissive|upl)", "upl", ("1 0",)),
    ("blueoak", "blue oak(?: model)?", "blueoak", ("1 0 0",)),
    ("mulan", "mulan(?: permissive software| psl)?", "mulanpsl", ("1 0", "2 0")),
    ("busl", "(?:business source|busl)", "busl", ("1 1",)),
    ("sspl", "(?:server side public|sspl)", "sspl", ("1 0",)),
    ("elastic", "elastic", "elastic", ("2 0",)),
    ("openrail", "(?:creativeml open ?rail m|open ?rail(?: m| s)?|bigscience (?:open )?rail)", "openrail", ()),
    ("llama", "llama(?: [0-9])?(?: community)?", "llama", ()),
]

#: Creative Commons: words of the element, label (fixed values).
CC = {
    "by nc nd": "cc-by-nc-nd", "by nc sa": "cc-by-nc-sa", "by nc": "cc-by-nc", "by nd": "cc-by-nd", "by sa": "cc-by-sa", "by": "cc-by",
    "attribution non ?commercial no ?deriv[a-z]*": "cc-by-nc-nd", "attribution non ?commercial share ?alike": "cc-by-nc-sa",
    "attribution non ?commercial": "cc-by-nc", "attribution no ?deriv[a-z]*": "cc-by-nd", "attribution share ?alike": "cc-by-sa", "attribution": "cc-by",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Sentences of license texts and notices: label, pattern, keywords (every match holds one), score (fixed values).
SENTENCES: list[tuple[str, str, str, float]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby", 0.99),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice", 0.9),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "permission is hereby", 0.99),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use", 0.99),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 0.95),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote", "endorse or promote", 0.97),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising materials", 0.97),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license", 0.9),
    ("apache-2.0", "www apache org licenses license 2 0", "apache org", 0.99),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software", 0.97),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version", "any later version", 0.9),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version", "any later version", 0.9),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version", "any later version", 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", 0.99),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla org", 0.95),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?", "cc0", 0.95),
    ("cc0-1.0", "creative commons zero", "creative commons", 0.9),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 0.9),
    ("public-domain", "this (?:work|file|software) is in the public domain", "public domain", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.99),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "permission is hereby", 0.97),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express or implied", 0.95),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "verbatim", 0.8),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 0.9),
    ("mit", "subject to the following conditions the above copyright notice and this permission notice", "permission notice", 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "express or implied", 0.85),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders", 0.85),
    ("mit-style", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use", 0.85),
    ("mit-feh", "the above copyright notice and this permission notice shall be included in all copies of the software and its documentation and acknowledgment shall be given", "permission notice", 0.95),
    ("x11", "except as contained in this notice the name of .{1,60}? shall not be used in advertising", "advertising", 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "permission to use", 0.95),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims all warranties", 0.9),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "permission to use", 0.97),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source", 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary", 0.95),
    ("bsd", "this software is provided by the copyright holders and contributors as is", "copyright holders", 0.9),
    ("bsd", "this software is provided by the regents and contributors as is", "regents", 0.9),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse", "endorse", 0.97),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent rights", 0.97),
    ("bsd-4-clause", "this product includes software developed by", "product includes software", 0.6),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual", "copyright holder", 0.97),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software", 0.97),
    ("apache-1.1", "products derived from this software may not be called apache", "be called apache", 0.97),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable law", 0.95),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", "language governing", 0.95),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache software", 0.97),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "hereby grants", 0.95),
    ("apache-2.0-llvm", "apache license v2 0 with llvm exceptions", "llvm exceptions", 0.98),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "general public", 0.95),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "in the hope", 0.8),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom to share", 0.97),
    ("gpl-2.0", "version 2 of the license only", "of the license", 0.9),
    ("gpl-2.0", "published by the free software foundation version 2", "free software", 0.9),
    ("gpl-3.0", "published by the free software foundation version 3", "free software", 0.9),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft", 0.97),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work", "combined work", 0.9),
    ("gpl-linking-exception", "as a special exception the copyright holders of this library give you permission to link this library", "special exception", 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general", 0.97),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "lesser general", 0.95),
    ("lgpl-2.0", "you should have received a copy of the gnu library general public license along with this library", "library general", 0.95),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lesser general", 0.97),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works", "affero", 0.97),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program", "affero", 0.95),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely", "interacting with it remotely", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation", 0.97),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts a copy of the license", "invariant sections", 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla public", 0.98),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind", "as is basis", 0.6),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 0.98),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "accompanying materials", 0.98),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", "accompanying materials", 0.98),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", "accompanying program", 0.97),
    ("edl-1.0", "eclipse distribution license v(?:ersion)? ?1 0", "eclipse distribution", 0.97),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development", 0.98),
    ("cddl-1.0", "you can obtain a copy of the license at usr src opensolaris license", "opensolaris", 0.95),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", "common public", 0.97),
    ("eupl", "this work is licensed under the eupl|licensed under the eupl", "eupl", 0.95),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software", 0.98),
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free", 0.98),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "package may be copied", 0.95),
    ("artistic", "you may redistribute it and or modify it under the same terms as perl itself", "same terms as perl", 0.9),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed", "free software package", 0.97),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software", 0.98),
    ("boost-1.0", "see accompanying file license 1 0 txt or copy at (?:.{0,10} )?(?:www )?boost org license", "boost org", 0.95),
    ("cecill", "ce logiciel est r.{1,3}gi par la licence cecill", "licence cecill", 0.97),
    ("cecill", "this software is governed by the cecill(?: [abc])? license", "cecill", 0.97),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "font software", 0.98),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "commercial applications", 0.97),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked", 0.9),
    ("libpng", "the png reference library is supplied as is", "png reference", 0.9),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 0.9),
    ("unlicense", "for more information please refer to (?:http|https) unlicense org", "unlicense", 0.97),
    ("wtfpl-2", "you just do what the fuck you want to (?:.{0,60} )?public license", "public license", 0.97),
    ("ncsa", "permission is hereby granted free of charge (?:.{0,160} )?to deal with the software without restriction", "deal with the software", 0.95),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl toolkit", 0.97),
    ("openssl", "redistributions of any form whatsoever must retain the following acknowledgment", "redistributions of any form", 0.9),
    ("php-3.01", "this product includes php software freely available from", "php software", 0.95),
    ("php-3.01", "this source file is subject to version 3 01 of the php license", "php license", 0.98),
    ("python-2.0", "python software foundation license version 2|psf license agreement for python", "license", 0.97),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "2 clause bsdl", 0.97),
    ("vim", "vim is charityware", "charityware", 0.95),
    ("postgresql", "permission to use copy modify and distribute this software (?:.{0,60} )?without fee and without a written agreement", "written agreement", 0.95),
    ("ecl-2.0", "licensed under the educational community license version 2 0", "educational community", 0.98),
    ("upl-1.0", "the universal permissive license upl version 1 0", "universal permissive", 0.98),
    ("blueoak-1.0.0", "this license gives everyone as much permission to work with this software as possible", "gives everyone", 0.97),
    ("mulanpsl-2.0", "licensed under mulan psl v2", "mulan psl", 0.98),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use", 0.97),
    ("busl-1.1", "change date (?:.{0,60} )?change license", "change license", 0.7),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", "as a service", 0.9),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "managed service", 0.9),
    ("commons-clause", "without limiting other conditions in the license the grant of rights under the license will not include (?:.{0,60} )?right to sell", "right to sell", 0.97),
    ("openrail", "use based restrictions", "use based restrictions", 0.6),
    ("openrail", "responsible ai license", "responsible ai", 0.9),
    ("llama", "meta llama [0-9](?: [0-9])? is licensed under the meta llama", "meta llama", 0.97),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "public domain", 0.97),
    ("cc0-1.0", "to the extent possible under law .{1,80}? (?:has|have) waived all copyright", "waived all copyright", 0.97),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit", 0.7),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license", "same license", 0.95),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial purposes", 0.8),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "modified material", 0.9),
    ("public-domain", "no copyright is claimed|no copyright reserved|not subject to copyright protection", "copyright", 0.85),
    ("public-domain", "public domain in the united states", "public domain", 0.85),
    ("us-government", "(?:a )?work of the united states government", "united states government", 0.8),
    ("us-government", "this software was developed by employees of .{1,80}? pursuant to title 17", "title 17", 0.85),
    ("odbl-1.0", "this database is made available under the open database license", "open database", 0.98),
    ("odc-by-1.0", "made available under the open data commons attribution license", "open data commons", 0.98),
    ("pddl-1.0", "made available under the public domain dedication and license", "dedication and license", 0.98),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "meet some day", 0.95),
    ("beerware", "beer ?ware license", "ware license", 0.95),
    ("json", "the software shall be used for good not evil", "for good", 0.95),
    ("json", "json license", "json license", 0.9),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission to use", 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg", 0.9),
    ("freetype", "portions of this software are copyright (?:.{0,30} )?the freetype project", "freetype", 0.97),
    ("intel-acpi", "intel grants to any recipient (?:.{0,80} )?under intel s copyrights", "intel s copyrights", 0.9),
    ("proprietary", "this software is the confidential and proprietary information of", "proprietary information", 0.9),
    ("proprietary", "no part of this (?:publication|document|work|book) may be reproduced", "may be reproduced", 0.6),
    ("proprietary", "you may not copy modify distribute or create derivative works", "derivative works", 0.6),
    ("proprietary", "end user license agreement", "license agreement", 0.6),
    ("proprietary", "licensed not sold", "not sold", 0.6),
    ("mit", "the software is furnished to do so subject to the following conditions|whom the software is furnished to do so", "software is furnished", 0.9),
    ("mit", "to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute", 0.95),
    ("mit-modern", "permission is hereby granted without written agreement and without license or royalty fees to use reproduce prepare derivative works", "permission is hereby", 0.95),
    ("mit-festival", "permission is hereby granted free of charge to use and distribute this software and its documentation without restriction", "permission is hereby", 0.95),
    ("mit-enna", "permission notice shall be included in all copies of the software and its copyright notices", "permission notice", 0.9),
    ("mit-advertising", "except as contained in this notice the names? of .{1,60}? shall not be used in advertising or otherwise to promote the sale", "advertising", 0.97),
    ("x11", "x window system is a trademark of", "x window system", 0.9),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies", "permission to use", 0.97),
    ("hpnd", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "publicity pertaining", 0.95),
    ("hpnd-sell", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", "permission to use", 0.97),
    ("smlnj", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies", "permission to use", 0.96),
    ("tcl", "existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions", "included verbatim", 0.97),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software", "authors hereby grant", 0.97),
    ("icu", "provided that the above copyright notices? and this permission notice appear in all copies of the data files or software", "data files or software", 0.97),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files", 0.98),
    ("unicode", "unicode license agreement data files and software|unicode terms of use", "unicode", 0.95),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "obtaining using", 0.97),
    ("w3c", "w3c software notice and license|w3c software and document notice", "w3c software", 0.97),
    ("w3c", "this work is being provided by the copyright holders under the following license", "copyright holders under", 0.9),
    ("bsd", "this software is provided by the author and contributors as is", "author and contributors", 0.9),
    ("bsd", "this software is provided by the author as is and any express or implied warranties", "provided by the author", 0.9),
    ("bsd", "in no event shall the (?:regents|copyright (?:holder|owner)s?|authors?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "exemplary or consequential", 0.9),
    ("bsd", "however caused and on any theory of liability whether in contract strict liability or tort", "theory of liability", 0.85),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd style", 0.97),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software", "endorse or promote", 0.9),
    ("bsd-3-clause-lbnl", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades", "bug fixes patches", 0.97),
    ("bsd-3-clause-no-nuclear", "software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear facility", 0.97),
    ("bsd-4-clause-uc", "this product includes software developed by the university of california berkeley and its contributors", "university of california", 0.97),
    ("bsd-source-code", "redistributions of source code must retain the copyright notice this list of conditions", "redistributions of source", 0.9),
    ("bsd-protection", "bsd protection license", "bsd protection", 0.98),
    ("apache-1.0", "redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the apache group", "apache group", 0.97),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", "patent license", 0.96),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files", "prominent notices", 0.95),
    ("apache-2.0", "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor", "trade names", 0.95),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation", "write to the free software", 0.97),
    ("gpl", "when we speak of free software we are referring to freedom not price", "freedom not price", 0.97),
    ("gpl", "the precise terms and conditions for copying distribution and modification follow", "precise terms", 0.9),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it", "verbatim copies", 0.95),
    ("gpl-2.0", "each time you redistribute the program or any work based on the program", "work based on the program", 0.95),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it", "convey verbatim", 0.97),
    ("gpl-3.0", "a covered work means either the unmodified program or a work based on the program", "covered work", 0.97),
    ("gpl-3.0", "to propagate a work means to do anything with it", "propagate a work", 0.97),
    ("gpl-autoconf-exception", "if you distribute this file as part of a program that contains a configuration script generated by autoconf", "generated by autoconf", 0.97),
    ("gpl-bison-exception", "you may create a larger work that contains part or all of the bison parser skeleton", "bison parser", 0.97),
    ("gpl-gcc-exception", "gcc runtime library exception", "gcc runtime", 0.98),
    ("gpl-openssl-exception", "permission to link the code of portions of this program with the openssl library", "openssl library", 0.97),
    ("gpl-font-exception", "if you create a document which uses this font and embed this font or unaltered portions", "embed this font", 0.97),
    ("lgpl", "the lesser general public license permits more lax criteria for linking other code with the library", "lax criteria", 0.97),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library", "no derivative of any portion", 0.97),
    ("lgpl-3.0", "an application is any work that makes use of an interface provided by the library", "interface provided by the library", 0.95),
    ("gfdl", "the purpose of this license is to make a manual textbook or other functional and useful document free", "manual textbook", 0.97),
    ("gfdl", "a secondary section is a named appendix or a front matter section", "secondary section", 0.95),
    ("mpl", "licensable means having the right to grant to the maximum extent possible", "licensable means", 0.9),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of", "contents of this file", 0.85),
    ("mpl-2.0-no-copyleft-exception", "this source code form is incompatible with secondary licenses", "secondary licenses", 0.97),
    ("npl", "the contents of this file are subject to the netscape public license", "netscape public", 0.98),
    ("spl", "the contents of this file are subject to the sun public license", "sun public", 0.98),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", "apple public source", 0.98),
    ("apple-sample", "in consideration of your agreement to the following terms and your use installation modification or redistribution of this apple software", "apple software", 0.97),
    ("ipl", "ibm public license", "ibm public", 0.97),
    ("epl", "contributor means any person or entity that distributes the program", "distributes the program", 0.85),
    ("cddl", "modifications means the source code and executable form of any of the following", "source code and executable form", 0.85),
    ("artistic", "the copyright holder maintains some semblance of artistic control", "artistic control", 0.97),
    ("artistic-1.0-perl", "you may otherwise modify your copy of this package in any way provided that you insert a prominent notice", "copy of this package", 0.95),
    ("artistic-clarified", "clarified artistic license", "clarified artistic", 0.98),
    ("ofl-1.1", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", "font software", 0.95),
    ("ofl-1.1", "this license is available with a faq at (?:http|https) scripts sil org ofl", "sil org", 0.98),
    ("ofl", "reserved font name", "reserved font name", 0.8),
    ("bitstream-vera", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", "fonts accompanying", 0.97),
    ("ubuntu-font", "ubuntu font licen[cs]e", "ubuntu font", 0.98),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented", 0.95),
    ("zlib", "this notice may not be removed or altered from any source distribution", "removed or altered", 0.95),
    ("bzip2", "bzip2 and libbzip2 (?:are )?copyright|this program bzip2", "bzip2", 0.9),
    ("infozip", "for the purposes of this copyright and license info zip is defined as", "info zip", 0.97),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that .{1,200}? sam leffler", "sam leffler", 0.97),
    ("imagemagick", "imagemagick studio llc|governed by the imagemagick license", "imagemagick", 0.9),
    ("sqlite-blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others", "forgiveness for yourself", 0.98),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "copyright interest", 0.97),
    ("cc0-1.0", "certain owners wish to permanently relinquish those rights to a work", "permanently relinquish", 0.97),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "unconditionally waives", 0.97),
    ("cc-by", "by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons attribution", "licensed rights", 0.9),
    ("cc-by", "the licensor waives the right to collect royalties for any exercise by you of the rights granted", "collect royalties", 0.85),
    ("cc-sampling-plus", "creative commons sampling plus", "sampling plus", 0.97),
    ("cc-devnations", "creative commons developing nations", "developing nations", 0.97),
    ("public-domain", "the authors? (?:has|have) placed this (?:file|work|code|software) in the public domain", "public domain", 0.95),
    ("public-domain", "dedicates? (?:any and all copyright interest|this work) to the public domain|no known copyright restrictions", "public domain|copyright restrictions", 0.85),
    ("us-government", "this work was prepared as an account of work sponsored by an agency of the united states government", "united states government", 0.9),
    ("us-government", "not subject to copyright protection (?:with)?in the united states", "copyright protection", 0.9),
    ("nist", "this software was developed at the national institute of standards and technology", "national institute of standards", 0.95),
    ("nasa-1.3", "nasa open source agreement", "nasa open source", 0.98),
    ("ogl-uk-3.0", "contains public sector information licensed under the open government licence", "public sector information", 0.98),
    ("etalab-2.0", "licence ouverte (?:open licence|etalab)|licence ouverte", "licence ouverte", 0.9),
    ("cdla-permissive", "community data license agreement permissive", "community data license", 0.98),
    ("cdla-sharing", "community data license agreement sharing", "community data license", 0.98),
    ("odbl-1.0", "any rights in individual contents of the database are licensed under the database contents license", "database contents", 0.97),
    ("osm", "openstreetmap contributors", "openstreetmap contributors", 0.8),
    ("hippocratic", "hippocratic license", "hippocratic", 0.95),
    ("anti-996", "anti 996 license", "anti 996", 0.97),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter) license", "polyform", 0.98),
    ("prosperity", "prosperity public license", "prosperity public", 0.98),
    ("parity", "parity public license", "parity public", 0.98),
    ("confluent", "confluent community license", "confluent community", 0.98),
    ("redis-source-available", "redis source available license", "redis source", 0.98),
    ("timescale", "timescale license agreement", "timescale license", 0.98),
    ("gemma", "gemma is provided under and subject to the gemma terms of use|gemma terms of use", "gemma terms", 0.97),
    ("llama", "llama [0-9](?: [0-9])? community license agreement", "community license", 0.97),
    ("openrail", "you agree not to use the model or derivatives of the model", "derivatives of the model", 0.9),
    ("openrail", "bigcode open ?rail m", "bigcode", 0.97),
    ("nvidia", "nvidia corporation and its licensors retain all intellectual property", "nvidia corporation", 0.95),
    ("qpl", "q public license", "q public", 0.95),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "complete source code", 0.97),
    ("jpl", "this software is provided as is by the california institute of technology|technology transfer at the california institute of technology", "california institute", 0.9),
    ("cern-ohl", "cern open hardware licen[cs]e", "cern open", 0.98),
    ("watcom", "sybase open watcom public license", "open watcom", 0.98),
    ("naumen", "naumen public license", "naumen", 0.98),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained", 0.98),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty", "without royalty", 0.97),
    ("fsful", "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", "unlimited permission", 0.97),
    ("gpl", "this file is free software the free software foundation gives unlimited permission", "unlimited permission", 0.5),
    ("latex-lppl", "this work may be distributed and or modified under the conditions of the latex project public license", "latex project", 0.98),
    ("latex-lppl", "this work has the lppl maintenance status", "lppl maintenance", 0.98),
    ("knuth-ctan", "this file may be freely copied and distributed provided that no changes whatsoever are made", "no changes whatsoever", 0.9),
    ("newsletr", "permission is granted to reproduce this document in whole or in part for non ?commercial", "reproduce this document", 0.8),
    ("proprietary", "this (?:software|document|material) contains (?:trade secrets|confidential information) of", "trade secrets|confidential information", 0.8),
    ("proprietary", "reverse engineer decompile or disassemble", "decompile or disassemble", 0.8),
    ("proprietary", "for internal use only do not (?:copy|distribute)|not for redistribution", "internal use only|not for redistribution", 0.6),
    ("proprietary", "for personal non ?commercial use only", "use only", 0.5),
    ("copyright-notice", "copyright (?:c )?(?:by )?[a-z][a-z0-9 ]{1,60}? [12][0-9]{3}", "copyright", 0.25),
    ("proprietary", "all rights reserved", "all rights reserved", 0.4),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", "proprietary", 0.8),
    ("proprietary", "unauthorized (?:copying|use|distribution|reproduction) (?:.{0,40} )?is strictly prohibited", "strictly prohibited", 0.8),
    ("copyright-notice", "copyright (?:c )?[12][0-9]{3}", "copyright", 0.3),
]

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Words at whose start a text becomes worth reading: every match of a family's rule holds one (fixed values).
GENERAL = (
    "licen[sc]", "spdx", "unlicense", "creative ?commons", "cc (?:by|attribution)", "cc0", "public domain", "permission", "redistribut", "copyright",
    "rights reserved", "proprietary", "prohibited", "verbatim", "advertising", "endorse", "express or", "free software",
    "mozilla", "apache", "unencumbered", "disclaims", "openssl", "anyone is free", "for good", "(?:released|distributed|published|available|provided|covered) under",
)


def _gate() -> str:
    """What lets a text through, tried on it as it is, in any case, before anything is rewritten: the general words, and the
    keywords of sentences that need hold none of them. Words stand by their first letter, so few are tried at a place."""
    general = re.compile("|".join(f"(?<![a-z0-9]){g}" for g in GENERAL))
    own = {k for _, _, kw, _ in SENTENCES for k in kw.split("|") if not general.search(k)}
    by_letter: dict[str, list[str]] = {}
    for x in (*GENERAL, *sorted(own)):
        by_letter.setdefault(x[0], []).append(x.replace(" ?", SEPARATOR + "*").replace(" ", f"{SEPARATOR}+"))
    branch = [x for xs in (by_letter.pop("(", []),) for x in xs] + [f"{c}(?:{'|'.join(x[1:] for x in xs)})" for c, xs in by_letter.items()]
    return r"(?i)(?<![0-9A-Za-z\x80-\x{10FFFF}])(?:" + "|".join(branch) + ")"


GATE = _gate()


def _dots(words: str) -> str:
    return words.replace(" ", ".") if " " in words else words + ".0"


def _literals(regex: str) -> tuple[str, ...]:
    """A word of each alternative of a name: every match holds one of them."""
    plain = re.sub(r"\(\?:[^()]*\)\?", " ", regex).replace("(?:", "").replace(")", "")
    return tuple(max(re.findall("[a-z0-9]+", x), key=len) for x in plain.split("|"))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order: base phrases, then the families' notices, SPDX lines, versions and titles, then sentences."""
    out = [Rule(label, phrase, (phrase,), 5, 0.7, True) for phrase, label in BASE.items()]
    under = f"(?:licen[sc]ed|released|distributed|published|available|provided|covered|made available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
    for label, name, spdx, versions in FAMILIES:
        name, words, short = f"(?:{name})", _literals(name), _literals(spdx)
        for v in versions:
            ver = f"(?:v(?:ersion)? ?)?{v}"
            long = "" if " " in v else "(?: 0)?"
            full = f"{label}-{_dots(v)}"
            out += [
                Rule(full, f"{under}{name}(?: {LICENCE})? {ver}{long}", words, 4, 0.98),
                Rule(full, f"{name} {LICENCE} {ver}{long}", words, 3, 0.9),
                Rule(full, f"spdx {LICENCE} identifier {spdx} {v}{long}(?: only| or later)?", ("spdx",), 4, 1.0),
            ]
        out += [
            Rule(label, f"{under}{name} {LICENCE}", words, 3, 0.9),
            Rule(label, f"spdx {LICENCE} identifier {spdx}", ("spdx",), 3, 0.95),
            Rule(label, f"{LICENCE} {spdx}(?: {LICENCE})?", short, 1, 0.6),
            Rule(label, f"{name} {LICENCE}", words, 2, 0.8),
        ]
    for words, label in CC.items():
        for v in CC_VERSIONS:
            out.append(Rule(f"{label}-{_dots(v)}", f"(?:cc|creative commons) {words} {v}(?: (?:international|unported|generic|{LICENCE}))*", ("cc ", "commons"), 4, 0.97))
            out.append(Rule(f"{label}-{_dots(v)}", f"creativecommons org licenses {words} {v}", ("creativecommons",), 4, 0.97))
        out.append(Rule(label, f"(?:cc|creative commons) {words}(?: {LICENCE})?", ("cc ", "commons"), 3, 0.85))
    out += [Rule(label, rx, tuple(kw.split("|")), 3, score) for label, rx, kw, score in SENTENCES]
    out += [
        Rule("licensed", f"{LICENCE}d under [a-z0-9 ]{{2,40}}?{LICENCE}", (" under ",), 1, 0.4),
        Rule("license-mention", f"(?:see|read|refer to) (?:the )?(?:file )?{LICENCE}(?: file| txt| md)?", ("see ", "read ", "refer "), 0, 0.2),
    ]
    return tuple(out)


def _rule_literal(rs: tuple[Rule, ...]) -> Column:
    """The rules as a constant array of structs, which the optimiser folds into one literal."""
    quoted = lambda s: "r'" + s + "'"
    one = lambda i, r: (
        f"named_struct('i', {i}, 'label', {quoted(r.label)}, 'rx', {quoted(f'(?<= )(?:{r.regex})(?= )')}, 'kws', array({', '.join(map(quoted, r.keywords))}), "
        f"'prio', {r.priority}, 'score', {r.score:.4f}D, 'base', {str(r.base).lower()})"
    )
    return F.expr(f"array({', '.join(one(i, r) for i, r in enumerate(rs))})")


OPEN, CLOSE = "\x01", "\x02"  # canonical texts hold no control characters
SPAN = "array<struct<start:int,end:int,i:int,label:string,prio:int,score:double,base:boolean>>"


def canonical(text: Column) -> Column:
    """The words in lower case, a space before and after each; empty if there is none."""
    words = F.btrim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), "^ +$", "")


def count_words(text: Column) -> Column:
    """Number of words: the parts between separators, without an empty one at either end."""
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    # the lambda binds the parts, which are then used three times
    return F.transform(F.array(F.split(text, f"{SEPARATOR}+", -1)), lambda p: F.greatest(F.lit(0), F.size(p) - blank(p[0]) - blank(F.element_at(p, -1))))[0].cast("long")


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _matches(canon: Column, rule: Column) -> Column:
    """Spans of one rule in words: its matches are marked, and the spaces before each mark count the words."""
    parts = F.split(F.regexp_replace(canon, rule["rx"], F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    span = lambda start, n: F.struct(
        start.cast("int").alias("start"), (start + n).cast("int").alias("end"), rule["i"].alias("i"), rule["label"].alias("label"),
        rule["prio"].alias("prio"), rule["score"].alias("score"), rule["base"].alias("base"))
    # odd parts are matches; a match of n words has n - 1 spaces, and the first word comes after one space
    acc = F.struct(F.lit(-1).alias("at"), F.lit(True).alias("out"), F.array().cast(SPAN).alias("got"))

    def step(a: Column, x: Column) -> Column:
        n = spaces(x)
        return F.struct((a["at"] + n).alias("at"), (~a["out"]).alias("out"), F.when(a["out"], a["got"]).otherwise(F.concat(a["got"], F.array(span(a["at"], n + 1)))).alias("got"))

    return F.aggregate(parts, acc, step, lambda a: a["got"])


def _resolve(spans: Column) -> Column:
    """Spans sorted by start, longest first, without those inside an earlier one of no lower priority."""
    key = lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), (-x["prio"]).alias("p"), x["i"].alias("i"), x.alias("x"))
    ordered = F.sort_array(F.transform(spans, key))
    levels = 6
    acc = F.struct(F.array(*[F.lit(-1)] * levels).alias("far"), F.array().cast(SPAN).alias("got"))

    def step(a: Column, k: Column) -> Column:
        x = k["x"]
        inside = F.exists(F.slice(a["far"], x["prio"] + 1, levels), lambda e: e >= x["end"])
        far = F.transform(a["far"], lambda e, p: F.when(p == x["prio"], F.greatest(e, x["end"])).otherwise(e))
        return F.when(inside, a).otherwise(F.struct(far.alias("far"), F.concat(a["got"], F.array(x)).alias("got")))

    return F.aggregate(ordered, acc, step, lambda a: a["got"])


def license_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, base (all base spans) and detections (the spans that stay), in words."""
    rs = rules()
    d = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    gated = F.when(F.col("_t").rlike(GATE), canonical(F.col("_t"))).otherwise(F.lit(""))
    d = d.select("doc_id", count_words(F.col("_t")).alias("n_words"), gated.alias("_c"))
    none = F.array().cast(SPAN)

    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rs for k in r.keywords})])
    present = F.when(F.col("_c") != "", F.filter(keywords, lambda k: F.contains(F.col("_c"), k))).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", "n_words", "_c", present.alias("_kw"))
    hit = F.filter(_rule_literal(rs), lambda r: F.arrays_overlap(r["kws"], F.col("_kw")))
    found = F.flatten(F.transform(hit, lambda r: _matches(F.col("_c"), r)))
    d = d.select("doc_id", "n_words", F.when(F.size("_kw") > 0, found).otherwise(none).alias("_all"))
    return d.select(
        "doc_id", "n_words", F.filter("_all", lambda x: x["base"]).alias("base"),
        F.when(F.size("_all") == 0, none).otherwise(_resolve(F.filter("_all", lambda x: ~x["base"]))).alias("detections"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda x: F.sort_array(F.array_distinct(F.transform(x, lambda s: s["label"])))
    everything = F.concat("base", "detections")
    score = F.coalesce(F.array_max(F.transform(everything, lambda s: s["score"])), F.lit(0.0))
    return license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["start"])).cast("long").alias("last_word"),
        F.array_join(labels(F.col("base")), ",").alias("base_labels"), F.array_join(labels(everything), ",").alias("labels"), score.alias("score"),
    )
