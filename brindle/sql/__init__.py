"""The dialect: tokens, syntax tree, parser and printers."""
