"""What pages made by builders, shops and frameworks show."""

#: Platforms in order: id, name, kind, and by field of a page the texts that show them.
FINGERPRINTS = """
durable | Durable AI | ai-builder | hosts: durable.co; powered: durable
mixo | Mixo AI | ai-builder | hosts: mixo.io; powered: mixo
b12 | B12 AI | ai-builder | hosts: b12.io, b12sites.com; powered: b12
tenweb | 10Web AI | ai-builder | hosts: 10web.io, 10web.site; powered: 10web
dora | Dora AI | ai-builder | hosts: dora.run; powered: dora
butternut | Butternut AI | ai-builder | hosts: butternut.ai; powered: butternut
relume | Relume AI | ai-builder | hosts: relume.io; powered: relume
zyro | Zyro / Hostinger AI | ai-builder | hosts: zyrosite.com, zyro.com; powered: zyro
hostinger | Hostinger AI Builder | ai-builder | hosts: awebstar, hostinger; powered: hostinger website builder, built with hostinger
lovable | Lovable | ai-builder | hosts: lovable.dev, lovableproject.com, gptengineer.app, cdn.gpteng.co, gpt-engineer-file-uploads; paths: /lovable-uploads/; ids: lovable-badge; powered: lovable
v0 | Vercel v0 | ai-builder | hosts: v0.dev, v0.build; powered: v0.dev, built with v0
bolt | Bolt.new | ai-builder | hosts: bolt.new, stackblitz; powered: bolt.new
wegic | Wegic AI | ai-builder | hosts: wegic.ai, wegic; powered: wegic
hocoos | Hocoos AI | ai-builder | hosts: hocoos; powered: hocoos
dorik | Dorik AI | ai-builder | hosts: dorik.io, dorik.com; powered: dorik
landingsite | Landingsite AI | ai-builder | hosts: landingsite.ai; powered: landingsite
sitekick | Sitekick AI | ai-builder | hosts: sitekick.ai; powered: sitekick
gamma | Gamma | ai-builder | hosts: gamma.app; powered: made with gamma, gamma.app
renderforest | Renderforest AI | ai-builder | hosts: renderforestsites.com; powered: renderforest
simplified | Simplified AI | ai-builder | hosts: simplified.com; powered: simplified
teleporthq | TeleportHQ | ai-builder | hosts: teleporthq; powered: teleporthq
pineapple | Pineapple Builder | ai-builder | hosts: pineapplebuilder; powered: pineapple builder
unicorn | Unicorn Platform | ai-builder | hosts: unicornplatform.com; powered: unicorn platform
typedream | Typedream | ai-builder | hosts: typedream.com, typedream.site; powered: typedream
jimdo | Jimdo (Dolphin AI) | ai-builder | hosts: jimdo.com, jimdofree.com, jimcdn.com; generator: jimdo; powered: jimdo
base44 | Base44 (Wix) | ai-builder | hosts: base44.app; ids: base44-badge; powered: base44, edit with base44
emergent | Emergent | ai-builder | hosts: emergent.host, emergent.sh; powered: emergent
framer | Framer | builder | hosts: framerusercontent.com, framer.app, framer.website, framer.com; generator: framer; attrs: data-framer-name; dataAttrs: data-framer; ids: __framer-badge-container; powered: framer
wix | Wix | builder | hosts: parastorage.com, wixstatic.com, wixsite.com, wix.com; generator: wix.com; attrs: data-wix-editor; dataAttrs: data-wix, data-mesh-id; powered: wix
webflow | Webflow | builder | hosts: website-files.com, webflow.io; generator: webflow; attrs: data-wf-page, data-wf-site; dataAttrs: data-wf-, data-w-id; classes: w-webflow-badge; powered: webflow
duda | Duda | builder | hosts: multiscreensite.com, dudaone, duda.co; generator: duda; dataAttrs: data-dm-; powered: duda
weebly | Weebly | builder | hosts: editmysite.com, weebly.com; generator: weebly; powered: weebly
strikingly | Strikingly | builder | hosts: strikinglycdn.com, strikingly.com; powered: strikingly
carrd | Carrd | builder | hosts: carrd.co; powered: carrd
tilda | Tilda | builder | hosts: tildacdn.com, tilda.ws; generator: tilda; classes: t-rec, t396; powered: tilda
squarespace | Squarespace | builder | hosts: squarespace.com, squarespace-cdn.com; generator: squarespace; powered: squarespace
readymag | Readymag | builder | hosts: readymag.com; powered: readymag
canva | Canva Sites | builder | hosts: canva.site; powered: canva
site123 | SITE123 | builder | hosts: site123; powered: site123
ukit | uKit | builder | hosts: ukit.com, ukit.me; powered: ukit
webnode | Webnode | builder | hosts: webnode; powered: webnode
webador | Webador | builder | hosts: webador; powered: webador
mozello | Mozello | builder | hosts: mozello; powered: mozello
godaddy | GoDaddy Website Builder / Airo | builder | hosts: img1.wsimg.com, godaddysites.com; powered: godaddy
bubble | Bubble | builder | hosts: bubbleapps.io, bubble.io; generator: bubble; dataAttrs: data-bubble; powered: bubble
softr | Softr | builder | hosts: softr.io, softr-files; powered: softr
glide | Glide | builder | hosts: glideapps.com, glide.page; powered: glide
super | Super.so (Notion) | builder | hosts: super.so, notion-static; powered: super.so
potion | Potion (Notion) | builder | hosts: potion.so; powered: potion
popsy | Popsy | builder | hosts: popsy.co; powered: popsy
builderio | Builder.io | builder | hosts: cdn.builder.io; dataAttrs: builder-; powered: builder.io
plasmic | Plasmic | builder | hosts: plasmic.app, plasmiccdn; classes: plasmic; powered: plasmic
webstudio | Webstudio | builder | hosts: wstd.io, webstudio.is; powered: webstudio
beacons | Beacons AI | builder | hosts: beacons.ai; powered: beacons
taplink | Taplink | builder | hosts: taplink.cc; powered: taplink
googlesites | Google Sites | builder | hosts: sites.google.com; powered: google sites
replit | Replit (Agent) | ai-builder | hosts: replit.dev, repl.co, replit.app, cdn.replit.com; powered: replit
notion | Notion Sites | builder | hosts: notion.site, notion.so; powered: notion
kajabi | Kajabi | builder | hosts: mykajabi.com, kajabi-cdn.com; powered: kajabi
substack | Substack | cms | hosts: substackcdn.com, substack.com; powered: substack
medium | Medium | cms | hosts: medium.com, miro.medium.com; powered: medium
gitbook | GitBook | docs | hosts: gitbook.io, gitbook.com; powered: gitbook
mkdocs | MkDocs | docs | generator: mkdocs; classes: md-content
elementor | Elementor | builder | classes: elementor-kit, elementor-widget; powered: elementor
divi | Divi | builder | classes: et_pb_section, et_pb_row; powered: divi
bricks | Bricks Builder | builder | classes: brxe-; dataAttrs: data-brx
breakdance | Breakdance | builder | classes: bde-, breakdance
oxygen | Oxygen | builder | classes: ct-section, oxy-
wpbakery | WPBakery | builder | classes: vc_row, wpb_
shopify | Shopify | ecommerce | hosts: cdn.shopify.com, myshopify.com; generator: shopify; powered: shopify
bigcommerce | BigCommerce | ecommerce | hosts: bigcommerce.com; powered: bigcommerce
wordpress | WordPress | cms | hosts: s.w.org; generator: wordpress; paths: /wp-content/, /wp-includes/; classes: wp-block-; powered: wordpress
ghost | Ghost | cms | generator: ghost; classes: gh-; powered: ghost
drupal | Drupal | cms | generator: drupal; paths: /sites/default/files/; powered: drupal
joomla | Joomla | cms | generator: joomla; powered: joomla
hubspot | HubSpot CMS | cms | hosts: hs-sites.com, hubspotusercontent; generator: hubspot; powered: hubspot
next | Next.js | framework | ids: __next; paths: /_next/
nuxt | Nuxt | framework | ids: __nuxt; paths: /_nuxt/
gatsby | Gatsby | framework | ids: ___gatsby, gatsby-focus-wrapper
astro | Astro | framework | attrs: data-astro-cid; dataAttrs: data-astro; paths: /_astro/; generator: astro
svelte | SvelteKit | framework | classes: svelte-; paths: /_app/immutable/
vue | Vue | framework | dataAttrs: data-v-
docusaurus | Docusaurus | docs | ids: __docusaurus; generator: docusaurus
hugo | Hugo | framework | generator: hugo
jekyll | Jekyll | framework | generator: jekyll
"""
#: Suffixes of hosts that a platform gives to its sites, and how the label before one must begin.
SUBDOMAINS = """
lovable | lovable.app, lovableproject.com
bolt | bolt.host
v0 | vercel.app | v0-
replit | replit.app, replit.dev
durable | durable.co, durable.site
mixo | mixo.io
b12 | b12sites.com
tenweb | 10web.site, 10web.cloud
dora | dora.run
hostinger | hostingersite.com, builder-preview.com
zyro | zyrosite.com
gamma | gamma.site
base44 | base44.app
emergent | emergent.host
unicorn | unicornplatform.page
typedream | typedream.app
wix | wixsite.com
squarespace | squarespace.com
framer | framer.website, framer.photos, framer.media, framer.wiki
webflow | webflow.io
jimdo | jimdosite.com, jimdofree.com
duda | multiscreensite.com
site123 | site123.me
carrd | carrd.co
notion | notion.site
super | super.site
canva | my.canva.site
godaddy | godaddysites.com
shopify | myshopify.com
"""
#: Hosts on which anything may be deployed.
DEPLOY_HOSTS = """vercel.app netlify.app pages.dev workers.dev github.io onrender.com up.railway.app railway.app fly.dev surge.sh streamlit.app hf.space glitch.me""".split()
