"""Views, registered queries and the settings they run under."""
