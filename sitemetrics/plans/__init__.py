"""The registered queries. Importing the modules fills the registry."""
