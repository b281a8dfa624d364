"""Part of evidencelake; see the modules inside."""
