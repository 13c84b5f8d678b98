"""Signature rules of the license scan, in order: tier, label, keyword that gates the rule, pattern.

Patterns are read over the words of a text (lower case, one space between, punctuation gone), so "CC-BY-SA 4.0" is
``cc by sa 4 0``. They begin and end at word borders; spaces in them are single. Tiers: 4 a machine-readable tag,
3 a sentence of the license text, 2 a notice that grants it, 1 a mention of its name. A detection is dropped where
one of a higher tier, or a longer one of its own tier, contains it; equal intervals go to the earlier rule.
"""

from __future__ import annotations

_SOURCE = """
4 mit spdx :: spdx license identifier mit
4 mit-0 spdx :: spdx license identifier mit 0
4 apache-1.1 spdx :: spdx license identifier apache 1 1
4 apache-2.0 spdx :: spdx license identifier apache 2 0
4 bsd-2-clause spdx :: spdx license identifier bsd 2 clause
4 bsd-3-clause spdx :: spdx license identifier bsd 3 clause
4 bsd-4-clause spdx :: spdx license identifier bsd 4 clause
4 0bsd spdx :: spdx license identifier 0bsd
4 isc spdx :: spdx license identifier isc
4 zlib spdx :: spdx license identifier zlib
4 gpl-1.0 spdx :: spdx license identifier gpl 1 0( only| or later)?
4 gpl-2.0-only spdx :: spdx license identifier gpl 2 0( only)?
4 gpl-2.0-or-later spdx :: spdx license identifier gpl 2 0 or later
4 gpl-3.0-only spdx :: spdx license identifier gpl 3 0( only)?
4 gpl-3.0-or-later spdx :: spdx license identifier gpl 3 0 or later
4 lgpl-2.0 spdx :: spdx license identifier lgpl 2 0( only| or later)?
4 lgpl-2.1-only spdx :: spdx license identifier lgpl 2 1( only)?
4 lgpl-2.1-or-later spdx :: spdx license identifier lgpl 2 1 or later
4 lgpl-3.0-only spdx :: spdx license identifier lgpl 3 0( only)?
4 lgpl-3.0-or-later spdx :: spdx license identifier lgpl 3 0 or later
4 agpl-3.0-only spdx :: spdx license identifier agpl 3 0( only)?
4 agpl-3.0-or-later spdx :: spdx license identifier agpl 3 0 or later
4 mpl-1.1 spdx :: spdx license identifier mpl 1 1
4 mpl-2.0 spdx :: spdx license identifier mpl 2 0
4 epl-1.0 spdx :: spdx license identifier epl 1 0
4 epl-2.0 spdx :: spdx license identifier epl 2 0
4 cddl-1.0 spdx :: spdx license identifier cddl 1 0
4 cddl-1.1 spdx :: spdx license identifier cddl 1 1
4 eupl-1.1 spdx :: spdx license identifier eupl 1 1
4 eupl-1.2 spdx :: spdx license identifier eupl 1 2
4 artistic-1.0 spdx :: spdx license identifier artistic 1 0
4 artistic-2.0 spdx :: spdx license identifier artistic 2 0
4 bsl-1.0 spdx :: spdx license identifier bsl 1 0
4 unlicense spdx :: spdx license identifier unlicense
4 wtfpl spdx :: spdx license identifier wtfpl
4 cc0-1.0 spdx :: spdx license identifier cc0 1 0
4 cc-by-3.0 spdx :: spdx license identifier cc by 3 0
4 cc-by-4.0 spdx :: spdx license identifier cc by 4 0
4 cc-by-sa-3.0 spdx :: spdx license identifier cc by sa 3 0
4 cc-by-sa-4.0 spdx :: spdx license identifier cc by sa 4 0
4 cc-by-nc-4.0 spdx :: spdx license identifier cc by nc 4 0
4 cc-by-nd-4.0 spdx :: spdx license identifier cc by nd 4 0
4 cc-by-nc-sa-4.0 spdx :: spdx license identifier cc by nc sa 4 0
4 cc-by-nc-nd-4.0 spdx :: spdx license identifier cc by nc nd 4 0
4 ofl-1.1 spdx :: spdx license identifier ofl 1 1
4 python-2.0 spdx :: spdx license identifier python 2 0
4 ncsa spdx :: spdx license identifier ncsa
4 postgresql spdx :: spdx license identifier postgresql
4 openssl spdx :: spdx license identifier openssl
4 odbl-1.0 spdx :: spdx license identifier odbl 1 0
4 afl-3.0 spdx :: spdx license identifier afl 3 0
4 osl-3.0 spdx :: spdx license identifier osl 3 0
4 ms-pl spdx :: spdx license identifier ms pl
4 ms-rl spdx :: spdx license identifier ms rl
4 upl-1.0 spdx :: spdx license identifier upl 1 0
4 vim spdx :: spdx license identifier vim
3 mit permission :: permission is hereby granted free of charge to any person obtaining a copy of this software
3 mit sublicense :: to use copy modify merge publish distribute sublicense and or sell copies of the software
3 mit copies :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 as-is warranty :: the software is provided as is without warranty of any kind
3 isc permission :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 isc permission :: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
3 bsd redistribution :: redistribution and use in source and binary forms with or without modification are permitted
3 bsd redistributions :: redistributions of source code must retain the above copyright notice
3 bsd redistributions :: redistributions in binary form must reproduce the above copyright notice
3 bsd-3-clause endorse :: neither the name of( [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
3 bsd-4-clause advertising :: all advertising materials mentioning features or use of this software must display
3 bsd warranties :: this software is provided by( [^ ]+){1,12} as is and any express or implied warranties
3 apache-2.0 compliance :: you may not use this file except in compliance with the license
3 apache-2.0 distributed :: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
3 apache-2.0 conditions :: terms and conditions for use reproduction and distribution
3 apache-1.1 apache :: this product includes software developed by the apache software foundation
3 gpl redistribute :: this program is free software you can redistribute it and or modify it
3 lgpl redistribute :: this library is free software you can redistribute it and or modify it
3 gpl useful :: this program is distributed in the hope that it will be useful but without any warranty
3 lgpl useful :: this library is distributed in the hope that it will be useful but without any warranty
3 gpl fitness :: without even the implied warranty of merchantability or fitness for a particular purpose
3 gpl verbatim :: everyone is permitted to copy and distribute verbatim copies of this license document
3 gpl copyleft :: the gnu general public license is a free copyleft license for software
3 agpl network :: all users interacting with it remotely through a computer network
3 mpl-2.0 obtain :: if a copy of the mpl was not distributed with this file you can obtain one at
3 mpl-2.0 mozilla :: this source code form is subject to the terms of the mozilla public license
3 mpl-1.1 mozilla :: the contents of this file are subject to the mozilla public license version 1 1
3 epl accompanying :: this program and the accompanying materials are made available under the terms of the eclipse public license
3 cddl contents :: the contents of this file are subject to the terms of the common development and distribution license
3 zlib altered :: altered source versions must be plainly marked as such
3 zlib misrepresented :: the origin of this software must not be misrepresented
3 zlib arising :: in no event will the authors be held liable for any damages arising from the use of this software
3 bsl-1.0 permission :: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
3 unlicense unencumbered :: this is free and unencumbered software released into the public domain
3 wtfpl fuck :: you just do what the fuck you want to
3 cc0 waived :: (has|have) waived all copyright and related or neighboring rights
3 cc0 dedicated :: the person who associated a work with this deed has dedicated the work to the public domain
3 cc-by adapt :: you are free to share( copy and redistribute the material in any medium or format)? and adapt
3 cc-by appropriate :: you must give appropriate credit provide a link to the license and indicate if changes were made
3 cc-by-sa remix :: if you remix transform or build upon the material you must distribute your contributions under the same license
3 cc-by-nc commercial :: you may not use the material for commercial purposes
3 cc-by-nd remix :: if you remix transform or build upon the material you may not distribute the modified material
3 ofl-1.1 font :: this font software is licensed under the sil open font license
3 ofl-1.1 reserved :: no modified version of the font software may use the reserved font name
3 artistic package :: the intent of this (document|artistic license) is to state the conditions under which a package may be copied
3 python psf :: psf hereby grants licensee a nonexclusive royalty free world wide license
3 ncsa deal :: to deal with the software without restriction
3 postgresql permission :: permission to use copy modify and distribute this software and its documentation for any purpose without fee
3 openssl openssl :: this product includes software developed by the openssl project
3 gfdl copy :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
3 gfdl invariant :: with no invariant sections no front cover texts and no back cover texts
3 odbl database :: this( [^ ]+)? database is made available under the open database license
3 public-domain domain :: (is|are) (hereby )?(placed|released|dedicated) (in|into|to) the public domain
3 beerware beer :: you can buy me a beer in return
3 json evil :: the software shall be used for good not evil
3 proprietary confidential :: (this|these) (document|software|material|materials|file|work) (is|are|contains|contain) confidential
3 proprietary proprietary :: (this|these) (document|software|material|materials|file|work) (is|are|contains|contain) proprietary
3 proprietary unauthorized :: unauthorized (copying|use|reproduction|distribution)( or [^ ]+){0,3} (of this [^ ]+ )?(via any medium )?is strictly prohibited
3 proprietary reproduced :: no part of this [^ ]+ may be reproduced
3 proprietary permission :: without (the )?(prior |express ){1,2}(written )?permission of the (author|publisher|owner|copyright holder)
3 proprietary consent :: without (the )?(prior |express ){1,2}(written )?consent of the (author|publisher|owner|copyright holder)
3 eula you :: by (installing|downloading|using|opening) (this|the) (software|product|package) you (agree|accept)
3 non-commercial noncommercial :: for (personal and )?noncommercial use only
3 non-commercial commercial :: for (personal and )?non commercial use only
2 mit mit :: (released|licensed|distributed|available|provided|published) under (the )?(terms of (the )?)?mit license
2 mit mit :: under the mit license
2 apache-2.0 apache :: licensed under the apache license( version)? 2 0
2 apache-2.0 apache :: (released|distributed|available|provided|published) under (the )?(terms of (the )?)?apache( license)?( version)? 2( 0)?
2 apache apache :: under the apache license
2 bsd bsd :: (released|licensed|distributed|available) under (the )?(terms of (the )?)?(a )?bsd( style)? license
2 bsd-2-clause bsd :: under the (2|two) clause bsd license
2 bsd-3-clause bsd :: under the (3|three) clause bsd license
2 bsd-2-clause bsd :: under the simplified bsd license
2 bsd-3-clause bsd :: under the (new|modified|revised) bsd license
2 gpl-2.0-or-later gnu :: under the terms of the gnu general public license as published by the free software foundation either version 2
2 gpl-3.0-or-later gnu :: under the terms of the gnu general public license as published by the free software foundation either version 3
2 gpl-2.0-only gnu :: under the terms of the gnu general public license version 2
2 gpl-3.0-only gnu :: under the terms of the gnu general public license version 3
2 gpl gnu :: under the terms of the gnu general public license
2 gpl-2.0 gpl :: (released|licensed|distributed|available) under (the )?(gnu )?gpl( v| version)? 2
2 gpl-3.0 gpl :: (released|licensed|distributed|available) under (the )?(gnu )?gpl( v| version)? 3
2 gpl gpl :: (released|licensed|distributed|available) under (the )?(gnu )?gpl
2 lgpl gnu :: under the terms of the gnu (lesser|library) general public license
2 lgpl-2.1 lesser :: gnu lesser general public license( as published by the free software foundation either)? version 2 1
2 lgpl-3.0 lesser :: gnu lesser general public license( as published by the free software foundation either)? version 3
2 lgpl lgpl :: (released|licensed|distributed|available) under (the )?(gnu )?lgpl
2 agpl affero :: under the terms of the gnu affero general public license
2 agpl-3.0 affero :: gnu affero general public license( as published by the free software foundation either)? version 3
2 agpl agpl :: (released|licensed|distributed|available) under (the )?(gnu )?agpl
2 mpl mozilla :: (released|licensed|distributed|available|subject) (under|to) (the )?(terms of (the )?)?mozilla public license
2 mpl mpl :: (released|licensed|distributed|available) under (the )?mpl
2 epl eclipse :: (released|licensed|distributed|available) under (the )?(terms of (the )?)?eclipse public license
2 eupl eupl :: licensed under the eupl
2 cc0 cc0 :: (released|licensed|dedicated|available|published) (under|to) (the )?(creative commons )?cc0
2 cc-by attribution :: creative commons attribution( [1-4] [05])?( international| unported| generic)? license
2 cc-by-sa attribution :: creative commons attribution (sharealike|share alike)( [1-4] [05])?( international| unported| generic)?( license)?
2 cc-by-nc attribution :: creative commons attribution (noncommercial|non commercial)( [1-4] [05])?( international| unported| generic)?( license)?
2 cc-by-nd attribution :: creative commons attribution (noderivatives|noderivs|no derivatives)( [1-4] [05])?( international| unported| generic)?( license)?
2 cc-by-nc-sa attribution :: creative commons attribution (noncommercial|non commercial) (sharealike|share alike)( [1-4] [05])?
2 cc-by-nc-nd attribution :: creative commons attribution (noncommercial|non commercial) (noderivatives|noderivs|no derivatives)( [1-4] [05])?
2 cc-by cc :: (released|licensed|distributed|available|published|shared) under (a |the )?(creative commons )?cc by
2 cc creative :: (released|licensed|distributed|available|published|shared) under (a |the )?(terms of (a |the )?)?creative commons
2 ofl-1.1 ofl :: (released|licensed|distributed|available) under (the )?(sil )?ofl
2 isc isc :: (released|licensed|distributed|available) under (the )?isc license
2 zlib zlib :: (released|licensed|distributed|available) under (the )?zlib( libpng)? license
2 bsl-1.0 boost :: (released|licensed|distributed|available) under (the )?boost software license
2 artistic artistic :: (released|licensed|distributed|available) under (the )?artistic license
2 perl perl :: (under|on) the same terms as perl( itself)?
2 unlicense unlicense :: (released|licensed|distributed|available) under (the )?unlicense
2 wtfpl wtfpl :: (released|licensed|distributed|available) under (the )?wtfpl
2 public-domain domain :: released (in|into|to) the public domain
2 odbl odbl :: (released|licensed|distributed|available) under (the )?odbl
2 gfdl gfdl :: (released|licensed|distributed|available) under (the )?(gnu )?gfdl
2 proprietary proprietary :: (proprietary and confidential|confidential and proprietary)
2 copyright copyright :: copyright( c)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?( by)?
2 copyright copr :: copr (19|20)[0-9]{2}
2 reserved rights :: no rights reserved
2 reserved rights :: some rights reserved
2 license-ref license :: see( the)? license (file )?for (more )?(details|information|terms)
2 license-ref license :: license that can be found in the license file
1 mit mit :: (the )?mit( x11)? license
1 mit expat :: expat license
1 apache-2.0 apache :: apache( software)? license( version)? 2( 0)?
1 apache apache :: apache( software)? license
1 bsd bsd :: bsd( style)? license
1 bsd-2-clause clause :: bsd (2|two) clause( license)?
1 bsd-3-clause clause :: bsd (3|three) clause( license)?
1 bsd-4-clause clause :: bsd (4|four) clause( license)?
1 gpl-2.0 gplv2 :: gplv2
1 gpl-3.0 gplv3 :: gplv3
1 gpl-2.0 gpl :: gpl( version)? 2( 0)?
1 gpl-3.0 gpl :: gpl( version)? 3( 0)?
1 gpl-2.0 general :: general public license( version| v)? 2( 0)?
1 gpl-3.0 general :: general public license( version| v)? 3( 0)?
1 gpl gnu :: gnu gpl
1 gpl gnu :: gnu general public licen[cs]e
1 lgpl lgpl :: (gnu )?lgpl
1 lgpl-2.1 lgplv2 :: lgplv2( 1)?
1 lgpl-3.0 lgplv3 :: lgplv3
1 lgpl lesser :: lesser general public license
1 agpl-3.0 agplv3 :: agplv3
1 agpl agpl :: (gnu )?agpl
1 agpl affero :: affero general public license
1 mpl mozilla :: mozilla public license
1 mpl-2.0 mozilla :: mozilla public license( version| v)? 2( 0)?
1 epl eclipse :: eclipse public license
1 epl-2.0 eclipse :: eclipse public license( version| v)? 2( 0)?
1 cddl common :: common development and distribution license
1 cpl common :: common public license
1 eupl european :: european union public licen[cs]e
1 cc-by-sa cc :: cc by sa( [1-4] [05])?
1 cc-by-nc cc :: cc by nc( [1-4] [05])?
1 cc-by-nd cc :: cc by nd( [1-4] [05])?
1 cc-by-nc-sa cc :: cc by nc sa( [1-4] [05])?
1 cc-by-nc-nd cc :: cc by nc nd( [1-4] [05])?
1 cc-by-4.0 cc :: cc by 4 0
1 cc-by-3.0 cc :: cc by 3 0
1 cc0 cc0 :: cc0( 1 0)?
1 cc creative :: creative commons( license)?
1 cc creativecommons :: creativecommons org (licenses|publicdomain)( [^ ]+){1,3}
1 ofl-1.1 sil :: sil open font license
1 artistic artistic :: artistic license( 2 0)?
1 python python :: python software foundation license
1 zlib zlib :: zlib license
1 isc isc :: isc license
1 bsl-1.0 boost :: boost software license
1 ncsa ncsa :: ncsa open source license
1 unlicense unlicense :: the unlicense
1 wtfpl wtfpl :: wtfpl
1 ms-pl microsoft :: microsoft public license
1 ms-rl microsoft :: microsoft reciprocal license
1 odbl database :: open database license
1 gfdl documentation :: free documentation license
1 upl universal :: universal permissive license
1 osl open :: open software license
1 afl academic :: academic free license
1 beerware beerware :: beerware license
1 public-domain domain :: public domain
1 fair-use fair :: fair use
1 copyleft copyleft :: copyleft
1 proprietary proprietary :: proprietary license
1 eula user :: end user licen[cs]e agreement
1 royalty-free royalty :: royalty free( license)?
1 shareware shareware :: shareware
1 freeware freeware :: freeware
"""


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, keyword, pattern) in order."""
    out = []
    for line in _SOURCE.strip().splitlines():
        head, _, pattern = line.partition(" :: ")
        tier, label, keyword = head.split(" ")
        out.append((int(tier), label, keyword, pattern))
    return out
